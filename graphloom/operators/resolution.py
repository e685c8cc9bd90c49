"""Entity resolution, relationship cleaning and filters on extracted graphs."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom import model as m
from graphloom.catalog import query
from graphloom.functions import text as t
from graphloom.functions.properties import deep_merged, surer_value
from graphloom.operators.relational import sql
from graphloom.operators.tiles import TILE, per_tile, tiles, unit_rows
from graphloom.plans.ordering import Ordered, first_untaken, pointer_ends
from graphloom.plans.scratch import discard, materialise_at


_BLANKS = " \t\n\r\f\x0b"


def merged_description(a: Column, b: Column, most: int = 8000) -> Column:
    """The one that holds the other, the longer if over half of the larger one's words are shared, else both, ``most`` characters at most.

    Two are joined as sentences; what is too long is cut behind the last sentence in the second half, else marked as cut. Null is empty.
    """
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    blank = f"[{_BLANKS}]"
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), f"{blank}+"), lambda w: w != ""))
    x, y = words(a), words(b)
    share = F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))
    head = F.regexp_replace(a, f"{blank}+$", "")
    both = F.concat(head, F.when((head != "") & ~F.right(head, F.lit(1)).isin(".", "!", "?"), ".").otherwise(""), F.lit(" "), F.regexp_replace(b, f"^{blank}+|{blank}+$", ""))
    cut = F.substring(both, 1, most - 3)
    back = F.locate(" .", F.reverse(cut))  # from its end, 0 if there is none
    short = F.when((back > 0) & (most - 3 - back - 1 > most // 2), F.substring(cut, F.lit(1), most - 3 - back)).otherwise(F.concat(F.regexp_replace(cut, f"{blank}+$", ""), F.lit("...")))
    one = F.when((a == "") | F.contains(b, a), b).when((b == "") | F.contains(a, b) | (F.length(a) >= most), a)
    longer = F.when(F.length(a) >= F.length(b), a).otherwise(b)
    one = F.coalesce(one, F.when((F.size(x) == 0) | (F.size(y) == 0) | (share > 0.5), longer))
    return F.when(one.isNotNull(), F.substring(one, 1, most)).when(F.length(both) > most, short).otherwise(both)


def exact_names(entities: DataFrame, by: list[str]) -> DataFrame:
    """Add canonical: the smallest ordinal of a source with the same name key (and ``by``)."""
    keyed = entities.withColumn("_key", t.name_key("name"))
    on = ["source_id", "_key", *by]
    first = keyed.groupBy(*[F.col(c).alias(f"_{c}") for c in on]).agg(F.min("ordinal").alias("canonical"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on])
    return keyed.where("_key is not null").join(first, same).select(*entities.columns, "canonical")


@query("er_exact", sql("SELECT ordinal, min(ordinal) OVER (PARTITION BY source_id, lower(trim(name))) AS canonical FROM entities"))
def er_exact(spark, d):
    return exact_names(m.entities(spark, d), []).select("ordinal", "canonical")


def greedy_aliases(entities: DataFrame, typed: bool = False) -> DataFrame:
    """(source_id, ordinal, canonical): in order, a name or alias that an earlier entity's name equals joins it.

    ``typed`` lets only entities of compatible types join. Entities without a name get no canonical. Only an entity that joined none can be joined, so who joins rests on
    earlier choices; all whose first candidate is settled choose at once, round by round. Candidates are the first of each name and type that may still be joined,
    a partial minimum, so no two rows of a common name are paired.
    """
    spent: list[str] = []

    def held(df: DataFrame, tag: str) -> DataFrame:
        table, path = materialise_at(df, tag)
        spent.append(path)
        return table

    key = lambda c: F.lower(F.trim(c))
    named = F.trim(F.coalesce("name", F.lit(""))) != ""
    kind = F.lower(F.trim(F.coalesce("type", F.lit("")))) if typed else F.lit("")
    every = F.concat(F.array(key("name")), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), key))
    rows = held(entities.select("source_id", "ordinal", named.alias("named"), kind.alias("kind"), key("name").alias("name"), F.filter(every, lambda k: k != "").alias("keys")), "rows")
    open_ = held(rows.where("named").select("source_id", "ordinal", "kind", "name", F.posexplode("keys").alias("place", "key")), "open")
    # (source_id, ordinal, kind, name, head): who may be joined, settled or not
    may = rows.where("named").select("source_id", "ordinal", "kind", "name", F.lit(False).alias("head"))
    joined = []
    generic = lambda c: F.col(c).isin(*t.GENERIC_TYPES)
    while True:
        first = may.groupBy("source_id", F.col("name").alias("key"), F.col("kind").alias("other")).agg(F.min(F.struct("ordinal", "head")).alias("first"))
        fits = (F.col("kind") == F.col("other")) | generic("kind") | generic("other")
        best = F.min(F.when(fits & (F.col("first.ordinal") < F.col("ordinal")), F.struct("place", "first"))).alias("best")
        seen = held(open_.join(first, ["source_id", "key"], "left").groupBy("source_id", "ordinal", "kind", "name").agg(best), "seen")
        heads = seen.where("best is null").select("source_id", "ordinal")
        now = seen.where("best.first.head").select("source_id", "ordinal", F.col("best.first.ordinal").alias("canonical"))
        joined.append(now)
        settled = heads.unionByName(now.select("source_id", "ordinal"))
        if seen.isEmpty():
            break
        open_ = held(open_.join(settled, ["source_id", "ordinal"], "left_anti"), "open")
        may = may.join(now, ["source_id", "ordinal"], "left_anti").join(heads.withColumn("_new", F.lit(True)), ["source_id", "ordinal"], "left")
        may = held(may.select("source_id", "ordinal", "kind", "name", (F.col("head") | F.coalesce("_new", F.lit(False))).alias("head")), "may")
    found = reduce(DataFrame.unionByName, joined)
    own = F.when(F.col("named"), F.coalesce("canonical", "ordinal"))
    out, _ = materialise_at(rows.select("source_id", "ordinal", "named").join(found, ["source_id", "ordinal"], "left").select("source_id", "ordinal", own.alias("canonical")), "aliases")
    for path in spent:
        discard(entities.sparkSession, path)
    return out


@query("er_exact_aliases")
def er_exact_aliases(spark, d):
    """Tested against a plain loop."""
    return greedy_aliases(m.mentions(spark, d), typed=True)


#: What equal names, a name among the other's aliases (each way) and a shared alias add to a similarity.
SAME_NAME, NAME_IN_ALIASES, SHARED_ALIAS = 0.20, 0.15, 0.10
#: Entities of a source from which only equal types are compared.
PARTITION_FROM = 50


def _bonuses(a: pa.Table, b: pa.Table) -> np.ndarray:
    """What names and aliases add, for each row of ``a`` with each of ``b``."""
    out = np.zeros((a.num_rows, b.num_rows))
    named, aliased = defaultdict(list), defaultdict(list)
    for k, (name, aliases) in enumerate(zip(b.column("name").to_pylist(), b.column("aliases").to_pylist(), strict=True)):
        named[name].append(k)
        for alias in set(aliases):
            aliased[alias].append(k)
    named, aliased = {k: np.array(v) for k, v in named.items() if k is not None}, {k: np.array(v) for k, v in aliased.items()}
    for k, (name, aliases) in enumerate(zip(a.column("name").to_pylist(), a.column("aliases").to_pylist(), strict=True)):
        row = out[k]
        if name in named:
            row[named[name]] += SAME_NAME
        if name in aliased:
            row[aliased[name]] += NAME_IN_ALIASES
        shared = [aliased[x] for x in set(aliases) if x in aliased]
        for x in set(aliases):
            if x in named:
                row[named[x]] += NAME_IN_ALIASES
        if shared:
            row[np.unique(np.concatenate(shared))] += SHARED_ALIAS
    return out


def similar_pairs(entities: DataFrame, threshold: float, no_bonus: float = 0.08, partition_from: int = PARTITION_FROM, groups: dict[str, list[str]] | None = None, tile: int = TILE) -> DataFrame:
    """(source_id, left, right, score) with left < right: pairs of one source at or above the threshold.

    The score is the cosine and bonuses for names and aliases, 1 at most; without any bonus the cosine must be ``no_bonus`` above the threshold. Types must be compatible
    (``groups`` names sets of types that are), in sources of ``partition_from`` entities or more equal. Vectors of different sizes, null ones and such with null components
    match nothing; a zero vector has cosine 0. A source, or in large ones each of its types, is compared in tiles.
    """
    kind = F.lower(F.trim(F.coalesce("type", F.lit("unknown"))))
    sized = entities.groupBy(F.col("source_id").alias("_source")).agg(F.count("*").alias("_n"))
    sound = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())
    rows = entities.join(sized, F.col("source_id").eqNullSafe(F.col("_source"))).where(sound & F.col("source_id").isNotNull()).select(
        "source_id", F.when(F.col("_n") >= partition_from, kind).alias("part"), F.size("embedding").alias("size"), F.col("ordinal").cast("bigint").alias("ordinal"), kind.alias("kind"), t.name_key("name").alias("name"),
        F.filter(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda k: t.name_key(k)), lambda k: k.isNotNull()).alias("aliases"), F.col("embedding").cast("array<double>").alias("embedding"),
    )
    low = [{x.lower() for x in members} for members in (groups or {}).values()]
    generic = set(t.GENERIC_TYPES)
    fits = lambda x, y: x == y or x in generic or y in generic or any(x in g and y in g for g in low)

    def compare(a: pa.Table, b: pa.Table) -> pa.RecordBatch:
        base = np.clip(unit_rows(a.column("embedding")) @ unit_rows(b.column("embedding")).T, -1.0, 1.0)
        bonus = _bonuses(a, b)
        score = np.minimum(1.0, base + bonus)
        found = (score >= threshold) & ((score > base) | (score >= threshold + no_bonus))
        x, y = a.column("ordinal").to_numpy(), b.column("ordinal").to_numpy()
        found &= x[:, None] < y[None, :] if a is b else x[:, None] != y[None, :]
        mine, theirs = a.column("kind").to_pylist(), b.column("kind").to_pylist()
        if a.column("part")[0].as_py() is None and found.any():
            names = {k: n for n, k in enumerate(sorted({*mine, *theirs}))}
            table = np.array([[fits(u, v) for v in names] for u in names])
            found &= table[np.array([names[k] for k in mine])[:, None], np.array([names[k] for k in theirs])[None, :]]
        i, j = np.nonzero(found)
        left, right = np.minimum(x[i], y[j]), np.maximum(x[i], y[j])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(i), a.column("source_id")[0].as_py()), pa.int64()), pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(score[i, j])], ["source_id", "left", "right", "score"])

    by = ["source_id", "part", "size"]
    return per_tile(tiles(rows, by, "ordinal", tile), by, compare, "source_id bigint, left bigint, right bigint, score double")


def _vectored(spark, d) -> DataFrame:
    """Vectors as entities of some sources, most of them one label's vectors, with fifty entities and more or fewer."""
    k = F.col("vec_id")
    return m.table(spark, d, "embeddings").select(
        F.when(k % 20 == 0, F.floor(k / F.lit(800)) + 100).otherwise(F.col("label")).cast("bigint").alias("source_id"), k.alias("ordinal"), F.concat(F.lit("Name"), k % 13).alias("name"),
        F.when(k % 19 == 0, "Thing").otherwise(F.concat(F.lit("t"), k % 3)).alias("type"),
        F.array(F.concat(F.lit("name"), (k * 3) % 17), F.concat(F.lit("alias"), k % 23)).alias("aliases"), F.round((k * 29 % 100) / 100, 2).alias("confidence"), "embedding",
    )


_V = "v AS MATERIALIZED (SELECT CASE WHEN vec_id % 20 = 0 THEN vec_id // 800 + 100 ELSE label END AS s, vec_id AS o, 'name' || vec_id % 13 AS n, ['name' || (vec_id * 3) % 17, 'alias' || vec_id % 23] AS al, CASE WHEN vec_id % 19 = 0 THEN 'thing' ELSE 't' || vec_id % 3 END AS ty, CAST(embedding AS DOUBLE[]) AS e, count(*) OVER (PARTITION BY CASE WHEN vec_id % 20 = 0 THEN vec_id // 800 + 100 ELSE label END) AS many FROM embeddings)"
_PAIRS = f"""WITH {_V}, p AS (SELECT a.s, a.o AS l, b.o AS r, list_cosine_similarity(a.e, b.e) AS base, CASE WHEN a.n = b.n THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN list_contains(b.al, a.n) THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN list_contains(a.al, b.n) THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN list_has_any(a.al, b.al) THEN 0.1::DOUBLE ELSE 0 END AS bonus
  FROM v a JOIN v b ON a.s = b.s AND a.o < b.o AND (a.ty = b.ty OR (a.many < 50 AND (a.ty = 'thing' OR b.ty = 'thing')))), q AS (SELECT *, least(1.0, base + bonus) AS score FROM p)"""


@query("er_similarity", f"{_PAIRS} SELECT l AS left_id, r AS right_id, round(score, 6) AS score FROM q WHERE score >= 0.3 AND (score > base OR score >= 0.38)")
def er_similarity(spark, d):
    """Sources of fifty entities and more, and smaller ones."""
    return similar_pairs(_vectored(spark, d), 0.3).select(F.col("left").alias("left_id"), F.col("right").alias("right_id"), F.round("score", 6).alias("score"))


def near_pairs(vectors: DataFrame, least: float, by: str = "source_id", key: str = "ordinal", tile: int = TILE) -> DataFrame:
    """(left, right, score), left < right: pairs of vectors of one ``by`` with a cosine of ``least`` or more, exact, in tiles; zero, null and other-sized vectors match nothing."""
    sound = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.where(sound).select(F.col(by).alias("of"), F.size("embedding").alias("size"), F.col(key).cast("bigint").alias("key"), F.col("embedding").cast("array<double>").alias("embedding"))

    def compare(a: pa.Table, b: pa.Table) -> pa.RecordBatch:
        score = unit_rows(a.column("embedding")) @ unit_rows(b.column("embedding")).T
        x, y = a.column("key").to_numpy(), b.column("key").to_numpy()
        i, j = np.nonzero((score >= least) & (x[:, None] < y[None, :] if a is b else x[:, None] != y[None, :]))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x[i], y[j])), pa.array(np.maximum(x[i], y[j])), pa.array(score[i, j])], ["left", "right", "score"])

    return per_tile(tiles(rows, ["of", "size"], "key", tile), ["of", "size"], compare, "left bigint, right bigint, score double")


@query("similarity_join", f"WITH {_V} SELECT a.o AS left_id, b.o AS right_id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.s = b.s AND a.o < b.o WHERE list_cosine_similarity(a.e, b.e) >= 0.25")
def similarity_join(spark, d):
    """Pairs of each source's vectors by cosine alone."""
    return near_pairs(_vectored(spark, d), 0.25).select(F.col("left").alias("left_id"), F.col("right").alias("right_id"), F.round("score", 6).alias("score"))


def greedy_merge(pairs: DataFrame, entities: DataFrame, threshold: float, penalty: float = 0.05) -> DataFrame:
    """(source_id, ordinal, canonical, confidence): in order, an entity not yet taken takes its later partners.

    confidence is that of the canonical entity after its merges: the higher one, less ``penalty`` where the score is within 0.10 of the threshold,
    0.1 at least. Others keep their own. Each merge is max(0.1, max(it, other) - penalty or 0), so the last is the largest of
    what any start is left with: the other's, or the entity's own, less the penalties that come after.
    """
    spent: list[str] = []
    met, path = materialise_at(pairs.select("source_id", "left", "right", "score"), "met")
    spent.append(path)
    taken = first_untaken(met, spent)
    by_left = met.join(taken.withColumnRenamed("node", "left"), ["source_id", "left"], "left_anti")
    taker = by_left.groupBy("source_id", "right").agg(F.min(F.struct("left", "score")).alias("by")).select("source_id", "right", "by.left", "by.score")
    sure = entities.select("source_id", F.col("ordinal").alias("right"), F.coalesce("confidence", F.lit(0.0)).alias("sure"))
    near = F.when(F.col("score") - threshold < 0.10, float(penalty)).otherwise(0.0)
    merges = taker.join(sure, ["source_id", "right"]).select("source_id", "left", "right", (-F.col("right")).alias("_last"), near.alias("loss"), "sure")
    order = Ordered(merges, ["source_id", "left"], ["_last"], spent)  # the last merge first: losses before a row come after it
    lost = order.before(order.rows, {"after": F.col("loss")}, start=0.0)
    best = lost.groupBy("source_id", F.col("left").alias("ordinal")).agg(F.max(F.greatest(F.lit(0.1), F.col("sure") - F.col("loss")) - F.col("after")).alias("best"), F.sum("loss").alias("losses"))
    of = taker.select("source_id", F.col("right").alias("ordinal"), F.col("left").alias("by"))
    own = entities.select("source_id", "ordinal", F.coalesce("confidence", F.lit(0.0)).alias("own"))
    confidence = F.coalesce(F.greatest(F.col("own") - F.col("losses"), F.col("best")), F.col("own"))
    out = own.join(of, ["source_id", "ordinal"], "left").join(best, ["source_id", "ordinal"], "left").select("source_id", "ordinal", F.coalesce("by", "ordinal").alias("canonical"), F.when(F.col("losses").isNull(), F.col("own")).otherwise(confidence).alias("confidence"))
    out, _ = materialise_at(out, "merged")
    for path in spent:
        discard(entities.sparkSession, path)
    return out


@query("er_semantic")
def er_semantic(spark, d):
    """Tested against a plain loop."""
    e = _vectored(spark, d)
    return greedy_merge(similar_pairs(e, 0.35), e, 0.35)


def name_pairs(entities: DataFrame) -> DataFrame:
    """(source_id, left, right, canonical): pairs of one source and type, left before right, that name the same; canonical is the fuller.

    One name holds the other from word border to word border, or all telling words of one are among the other's and at least 40 % of them. A name held across a
    border is another word, so such a pair never counts. Pairs without a common word can't fit and aren't formed.
    """
    key = t.name_key("name")
    e = entities.select("source_id", F.coalesce("type", F.lit("Unknown")).alias("type"), "ordinal", key.alias("k"), F.array_distinct(t.significant_words("name")).alias("w")).where((F.size("w") > 0) & (F.col("k") != ""))
    each = e.withColumn("word", F.explode(F.array_distinct(F.filter(F.split("k", r"[^\p{L}\p{N}]+"), lambda x: x != ""))))
    a, b = each.alias("a"), each.alias("b")
    met = a.join(b, (F.col("a.source_id") == F.col("b.source_id")) & (F.col("a.type") == F.col("b.type")) & (F.col("a.word") == F.col("b.word")) & (F.col("a.ordinal") < F.col("b.ordinal")))
    pairs = met.select("a.source_id", F.col("a.ordinal").alias("left"), F.col("b.ordinal").alias("right"), F.col("a.k").alias("ka"), F.col("b.k").alias("kb"), F.col("a.w").alias("wa"), F.col("b.w").alias("wb")).dropDuplicates(["source_id", "left", "right"])
    differ = F.col("ka") != F.col("kb")
    a_in_b, b_in_a = differ & F.contains("kb", "ka"), differ & F.contains("ka", "kb")
    subset = lambda x, y: (F.size(F.array_except(x, y)) == 0) & (F.size(x) / F.size(y) >= 0.4)
    canonical = (
        F.when(a_in_b, F.when(t.at_word_boundary(F.col("kb"), F.col("ka")), F.col("right")))
        .when(b_in_a, F.when(t.at_word_boundary(F.col("ka"), F.col("kb")), F.col("left")))
        .when(subset("wa", "wb"), F.col("right")).when(subset("wb", "wa"), F.col("left"))
    )
    return pairs.select("source_id", "left", "right", canonical.alias("canonical")).where("canonical is not null")


_N = "n AS (SELECT source_id AS s, 'any' AS ty, ordinal AS o, lower(trim(name, ' ')) AS k, list_distinct(list_filter(string_split(lower(trim(name, ' ')), ' '), lambda w: length(w) > 1 AND w NOT IN ('mr', 'mrs', 'ms', 'dr', 'prof', 'sir', 'lady', 'lord', 'the'))) AS w FROM mentions)"
_AT = "(instr({long}, {short}) = 1 OR NOT regexp_matches({long}[instr({long}, {short}) - 1], '[\\p{{L}}\\p{{N}}]')) AND NOT regexp_matches({long}[instr({long}, {short}) + length({short})], '[\\p{{L}}\\p{{N}}]')"


@query("fuzzy_name_join", sql(f"""WITH {_N}, p AS (SELECT a.s, a.o AS l, b.o AS r, a.k AS ka, b.k AS kb, a.w AS wa, b.w AS wb FROM n a JOIN n b ON a.s = b.s AND a.ty = b.ty AND a.o < b.o WHERE len(a.w) > 0 AND len(b.w) > 0),
  c AS (SELECT l, r, CASE WHEN ka <> kb AND contains(kb, ka) THEN CASE WHEN {_AT.format(long='kb', short='ka')} THEN r END WHEN ka <> kb AND contains(ka, kb) THEN CASE WHEN {_AT.format(long='ka', short='kb')} THEN l END
    WHEN list_has_all(wb, wa) AND len(wa) / len(wb) >= 0.4 THEN r WHEN list_has_all(wa, wb) AND len(wb) / len(wa) >= 0.4 THEN l END AS c FROM p) SELECT l AS left_id, r AS right_id, c AS canonical FROM c WHERE c IS NOT NULL"""))
def fuzzy_name_join(spark, d):
    """All names of a document as one type."""
    return name_pairs(m.mentions(spark, d).withColumn("type", F.lit("any"))).select(F.col("left").alias("left_id"), F.col("right").alias("right_id"), "canonical")


def hierarchical(entities: DataFrame) -> DataFrame:
    """(source_id, ordinal, canonical): names folded into fuller ones, each to the end of its chain.

    Pairs are taken in order of left, then right; an entity folded before its turn looks for no more, one folded is no partner. Only a fuller left name folds another before
    that one's turn, so who has a turn is settled by these pairs alone. In its turn an entity takes, or goes into, each partner that none before took; one that it takes
    follows it to where it went last.
    """
    spent: list[str] = []
    pairs, path = materialise_at(name_pairs(entities), "pairs")
    spent.append(path)
    takes = F.col("canonical") == F.col("left")
    folded = first_untaken(pairs.where(takes), spent)
    turns = pairs.join(folded.withColumnRenamed("node", "left"), ["source_id", "left"], "left_anti")
    taker = turns.where(takes).groupBy("source_id", "right").agg(F.min("left").alias("taker"))
    real = turns.join(taker, ["source_id", "right"], "left").where(F.when(takes, F.col("taker") == F.col("left")).otherwise(F.col("taker").isNull() | (F.col("taker") > F.col("left"))))
    order = Ordered(real.select("source_id", "left", "right", takes.alias("takes")), ["source_id", "left"], ["right"], spent)
    went = F.when(~F.col("takes"), F.col("right"))
    seen = order.before(order.rows, {"went": went}, F.max, start=None)
    into = seen.where("takes").select("source_id", F.col("right").alias("node"), F.coalesce("went", "left").alias("to"))
    last = order.rows.where("not takes").groupBy("source_id", F.col("left").alias("node")).agg(F.max("right").alias("to"))
    ends = pointer_ends(into.unionByName(last), spent)
    out = entities.select("source_id", "ordinal").join(ends.withColumnRenamed("node", "ordinal"), ["source_id", "ordinal"], "left").select("source_id", "ordinal", F.coalesce("end", "ordinal").alias("canonical"))
    out, _ = materialise_at(out, "hierarchy")
    for path in spent:
        discard(entities.sparkSession, path)
    return out


@query("er_hierarchical")
def er_hierarchical(spark, d):
    """Tested against a plain loop; all names of a document as one type."""
    return hierarchical(m.mentions(spark, d).withColumn("type", F.lit("any")))


def merged_value(a: Column, b: Column, a_sure: Column, b_sure: Column) -> Column:
    """Of two texts: the surer entity's if either is shorter than 20 characters, else the longer; ties go to the first."""
    short = F.least(F.length(a), F.length(b)) < 20
    return F.when(a.isNull(), b).when(b.isNull() | (a == b), a).when(short, F.when(a_sure >= b_sure, a).otherwise(b)).otherwise(F.when(F.length(a) >= F.length(b), a).otherwise(b))


def merged_properties(a: Column, b: Column, a_sure: Column, b_sure: Column, nested: bool = False) -> Column:
    """Two maps of texts by :func:`merged_value` of each key; ``nested``: two VARIANT objects, lists joined and objects in them merged in turn."""
    if nested:
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(deep_merged(a, b, surer_value(a_sure, b_sure)))
    return F.map_zip_with(a, b, lambda k, x, y: merged_value(x, y, a_sure, b_sure))


def merged_entities(entities: DataFrame, canonical: DataFrame, penalty: float = 0.0) -> DataFrame:
    """One row (source_id, canonical, name, type, aliases, confidence, description, properties, source_chunk_indices, history, merged) per canonical entity.

    The canonical row is folded with the others in order: names become aliases (title words don't, they go to history), the surer one's type and values win,
    descriptions join, chunks unite, and history keeps each time the lower confidence. A group is one entity's mentions in one document.
    """
    props = F.col("properties") if "properties" in entities.columns else F.create_map().cast("map<string,string>")
    nested = "properties" in entities.columns and entities.schema["properties"].dataType.typeName() == "variant"
    rows = entities.join(canonical.where("canonical is not null").select("source_id", "ordinal", "canonical"), ["source_id", "ordinal"])
    chunk = F.when(F.col("chunk_index").isNotNull(), F.array("chunk_index")).otherwise(F.array().cast("array<int>"))
    item = F.struct(
        (F.col("ordinal") != F.col("canonical")).alias("later"), "ordinal", "name", "type", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("description", F.lit("")).alias("description"), props.alias("properties"), chunk.alias("chunks"), F.array().cast("array<double>").alias("lost"), F.array().cast("array<string>").alias("skipped"),
    )
    groups = rows.groupBy("source_id", "canonical").agg(F.array_sort(F.collect_list(item), lambda a, b: F.when(F.struct(a["later"], a["ordinal"]) < F.struct(b["later"], b["ordinal"]), -1).otherwise(1)).alias("rows"))

    def fold(s: Column, x: Column) -> Column:
        title = F.lower(F.trim(x["name"])).isin(*t.TITLES)
        other = F.lower(x["name"]) != F.lower(s["name"])
        named = F.when(other & ~title, F.array(x["name"])).otherwise(F.array().cast("array<string>"))
        low = F.least(s["confidence"], x["confidence"])
        put = {
            "type": F.when((x["confidence"] > s["confidence"]) & (F.coalesce(x["type"], F.lit("")) != ""), x["type"]).otherwise(s["type"]),
            "aliases": F.array_union(s["aliases"], F.concat(x["aliases"], named)),
            "confidence": F.greatest(F.lit(0.1), F.greatest(s["confidence"], x["confidence"]) - penalty),
            "description": F.when(s["description"] == "", x["description"]).when(x["description"] == "", s["description"]).otherwise(merged_description(s["description"], x["description"])),
            "properties": merged_properties(s["properties"], x["properties"], s["confidence"], x["confidence"], nested),
            "chunks": F.array_union(s["chunks"], x["chunks"]),
            "lost": F.when(low > 0, F.array_append(s["lost"], low)).otherwise(s["lost"]),
            "skipped": F.when(other & title, F.array_append(s["skipped"], x["name"])).otherwise(s["skipped"]),
        }
        return F.struct(*[put.get(c, s[c]).alias(c) for c in ("later", "ordinal", "name", "type", "aliases", "confidence", "description", "properties", "chunks", "lost", "skipped")])

    done = groups.select("source_id", "canonical", F.size("rows").alias("merged"), F.aggregate(F.slice("rows", 2, F.greatest(F.lit(0), F.size("rows") - 1)), F.get("rows", F.lit(0)), fold).alias("e"))
    return done.select(
        "source_id", "canonical", "e.name", "e.type", F.array_sort("e.aliases").alias("aliases"), "e.confidence", "e.description", "e.properties", F.array_sort("e.chunks").alias("source_chunk_indices"),
        F.struct(F.col("e.lost").alias("confidence"), F.col("e.skipped").alias("aliases_skipped")).alias("history"), "merged",
    )


@query("er_merge", sql("""WITH c AS (SELECT *, min(ordinal) OVER (PARTITION BY source_id, type) AS canonical FROM mentions), f AS (SELECT *, first_value(name) OVER w AS head, max(confidence) OVER (PARTITION BY source_id, canonical ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c WINDOW w AS (PARTITION BY source_id, canonical ORDER BY ordinal)),
  al AS (SELECT source_id, canonical, list_sort(list_distinct(flatten(list(x)))) AS aliases FROM (SELECT source_id, canonical, aliases || CASE WHEN lower(name) <> lower(head) AND lower(name) <> 'the' THEN [name] ELSE [] END AS x FROM f) GROUP BY 1, 2)
  SELECT f.source_id, f.canonical, any_value(head) AS name, max(confidence) AS confidence, array_to_string(any_value(al.aliases), ',') AS aliases, string_agg(DISTINCT chunk_index, ',' ORDER BY chunk_index) AS chunks, coalesce(string_agg(CASE WHEN least(before, confidence) > 0 THEN CAST(CAST(round(100 * least(before, confidence)) AS INTEGER) AS VARCHAR) END, ',' ORDER BY ordinal) FILTER (WHERE before IS NOT NULL), '') AS lost,
  coalesce(string_agg(CASE WHEN lower(name) = 'the' AND lower(name) <> lower(head) THEN name END, ','), '') AS skipped, CAST(count(*) AS INTEGER) AS merged FROM f JOIN al ON al.source_id = f.source_id AND al.canonical = f.canonical GROUP BY 1, 2"""))
def er_merge(spark, d):
    """Entities of one type in a document, merged into the first; descriptions and properties are tested on their own."""
    e = m.mentions(spark, d)
    first = e.select("source_id", "ordinal", F.min("ordinal").over(Window.partitionBy("source_id", "type")).alias("canonical"))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    lost = F.array_join(F.transform("history.confidence", lambda x: F.round(x * 100).cast("int").cast("string")), ",")
    return merged_entities(e, first).select("source_id", "canonical", "name", "confidence", text("aliases").alias("aliases"), text("source_chunk_indices").alias("chunks"), lost.alias("lost"), text("history.aliases_skipped").alias("skipped"), "merged")


def remapped(relationships: DataFrame, canonical: DataFrame) -> DataFrame:
    """Relationships between canonical entities; unknown ends and new self loops go."""
    a, b = canonical.select(F.col("ordinal").alias("source"), F.col("canonical").alias("_a")), canonical.select(F.col("ordinal").alias("target"), F.col("canonical").alias("_b"))
    joined = relationships.join(a, "source").join(b, "target").where("_a <> _b")
    return joined.withColumns({"source": F.col("_a"), "target": F.col("_b")}).drop("_a", "_b")


@query("er_remap", sql("WITH c AS (SELECT ordinal, min(ordinal) OVER (PARTITION BY source_id, lower(trim(name))) AS canonical FROM entities) SELECT r.ordinal, a.canonical AS source, b.canonical AS target FROM relationships r JOIN c a ON r.source = a.ordinal JOIN c b ON r.target = b.ordinal WHERE a.canonical <> b.canonical"))
def er_remap(spark, d):
    return remapped(m.relationships(spark, d), exact_names(m.entities(spark, d), []).select("ordinal", "canonical")).select("ordinal", "source", "target")


def canonical_relations(r: DataFrame, symmetric: tuple[str, ...], inverse: dict[str, str]) -> DataFrame:
    """Symmetric types with the smaller end first; inverse types under their counterpart, turned around."""
    turned = F.col("type").isin(*inverse)
    name = F.col("type")
    for a, b in inverse.items():
        name = F.when(F.col("type") == a, b).otherwise(name)
    swap = (F.col("type").isin(*symmetric) & (F.col("source") > F.col("target"))) | turned
    return r.withColumns({"type": name, "source": F.when(swap, F.col("target")).otherwise(F.col("source")), "target": F.when(swap, F.col("source")).otherwise(F.col("target"))})


@query("rel_dedup", sql("""SELECT s AS source, t AS target, ty AS type, chunk_index, max(confidence) AS confidence FROM (SELECT *, CASE WHEN type = 'part_of' THEN 'owns' ELSE type END AS ty, CASE WHEN type = 'near' AND source > target OR type = 'part_of' THEN target ELSE source END AS s,
  CASE WHEN type = 'near' AND source > target OR type = 'part_of' THEN source ELSE target END AS t FROM relationships) GROUP BY ALL"""))
def rel_dedup(spark, d):
    """Of equal triples in a chunk the most confident."""
    r = canonical_relations(m.relationships(spark, d), ("near",), {"part_of": "owns"})
    return r.groupBy("source", "target", "type", "chunk_index").agg(F.max("confidence").alias("confidence"))


@query("rel_merge_within_task", sql("SELECT source, target, type, max(confidence) AS confidence, count(DISTINCT justification_length) AS justifications FROM relationships GROUP BY ALL"))
def rel_merge_within_task(spark, d):
    return m.relationships(spark, d).groupBy("source", "target", "type").agg(F.max("confidence").alias("confidence"), F.count_distinct("justification_length").alias("justifications"))
