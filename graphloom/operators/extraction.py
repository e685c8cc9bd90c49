"""What cleans a model's extractions: evidence, types, structure, plausibility, limits and domains.

Entities are rows (source_id, chunk_index, ordinal, name, type, aliases, description, sent_ref, confidence), relationships rows
(source_id, chunk_index, ordinal, source, target, type, sent_ref, confidence) whose ends are ordinals. A source is a document:
what depends on the order of its rows is resolved source by source, everything else is joins and columns. Null names,
types and references count as empty ones.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom import model as m
from graphloom.catalog import query
from graphloom.functions import text as t
from graphloom.operators.relational import sql
from graphloom.plans.ordering import Ordered
from graphloom.plans.scratch import discard, few, materialise, materialise_at

# ---- presets -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Filtering:
    """How strictly extractions are cleaned."""

    evidence_validation_mode: str = "standard"
    min_significant_word_length: int = 4
    strict_edge_type_constraints: bool = False
    enable_type_constraints: bool = True
    enable_plausibility_filter: bool = True
    plausibility_threshold: float = 0.30
    plausibility_threshold_non_named: float = 0.15
    visual_content_plausibility_factor: float = 0.5
    enable_relationship_limits: bool = True
    max_entity_degree: int = 25
    max_same_source_type: int = 12
    max_relationship_ratio: float = 8.0
    enable_structural_filter: bool = True
    enable_entity_exclusions: bool = True
    protect_orphans: bool = False
    semantic_dedup_threshold: float = 0.95
    loop_max_entity_count: int = 50
    minimum_alias_length: int = 2
    enable_direction_correction: bool = True
    enable_type_rescue: bool = True
    allow_self_loops: bool = False


_RAW = {"enable_type_constraints": False, "enable_plausibility_filter": False, "enable_structural_filter": False, "enable_entity_exclusions": False, "protect_orphans": True, "enable_type_rescue": False, "minimum_alias_length": 1}
_HARD = {"evidence_validation_mode": "strict", "strict_edge_type_constraints": True, "visual_content_plausibility_factor": 1.0, "minimum_alias_length": 3}
# What each preset changes, from the loosest to the tightest.
PRESETS: dict[str, dict] = {
    "unfiltered": _RAW | {"evidence_validation_mode": "off", "enable_relationship_limits": False, "loop_max_entity_count": 200, "semantic_dedup_threshold": 0.99},
    "minimal": _RAW | {"evidence_validation_mode": "relaxed", "max_entity_degree": 50, "max_same_source_type": 20, "max_relationship_ratio": 15.0, "loop_max_entity_count": 100, "semantic_dedup_threshold": 0.97},
    "lenient": {"evidence_validation_mode": "narrative", "plausibility_threshold": 0.20, "plausibility_threshold_non_named": 0.10, "max_entity_degree": 30, "max_same_source_type": 15, "max_relationship_ratio": 10.0, "loop_max_entity_count": 75, "semantic_dedup_threshold": 0.93},
    "balanced": {"semantic_dedup_threshold": 0.90},
    "strict": _HARD | {"max_entity_degree": 20, "max_same_source_type": 10, "max_relationship_ratio": 6.0, "loop_max_entity_count": 35, "semantic_dedup_threshold": 0.87},
    "maximum": _HARD | {"plausibility_threshold": 0.40, "plausibility_threshold_non_named": 0.25, "max_entity_degree": 15, "max_same_source_type": 7, "max_relationship_ratio": 4.0, "loop_max_entity_count": 25, "semantic_dedup_threshold": 0.85},
}


def filtering(mode: str = "balanced", domain: dict | None = None, source: dict | None = None, strict: bool = False) -> Filtering:
    """A preset with a domain's changes and over them a source's; unknown keys are left out, with ``strict`` an error."""
    if mode not in PRESETS:
        raise ValueError(f"no preset {mode!r}; there are {', '.join(PRESETS)}")
    known = {f.name for f in fields(Filtering)}
    if "extraction_filtering_mode" in (domain or {}):
        raise ValueError("the preset is chosen by mode, not by a domain")
    if strict and (odd := set(domain or {}) - known):
        raise ValueError(f"unknown settings: {', '.join(sorted(odd))}")
    changes = PRESETS[mode] | (domain or {}) | (source or {})
    return replace(Filtering(), **{k: v for k, v in changes.items() if k in known})


_PRESET_ROWS = """('unfiltered', 'off', 25, 12, 8.0, 0.99, 200, true), ('minimal', 'relaxed', 50, 20, 15.0, 0.97, 100, true), ('lenient', 'narrative', 30, 15, 10.0, 0.93, 75, false),
  ('balanced', 'standard', 25, 12, 8.0, 0.9, 50, false), ('strict', 'strict', 20, 10, 6.0, 0.87, 35, false), ('maximum', 'strict', 15, 7, 4.0, 0.85, 25, false)"""


@query("filter_presets", sql(f"""WITH p(preset, mode, degree, same, ratio, threshold, loops, orphans) AS (VALUES {_PRESET_ROWS})
  SELECT source_id, preset, mode, CASE WHEN source_id % 7 = 0 THEN 5 ELSE degree END AS degree, CASE WHEN source_id % 5 = 0 THEN 3 ELSE same END AS same, CAST(ratio AS DOUBLE) AS ratio, CAST(threshold AS DOUBLE) AS threshold, loops, CASE WHEN source_id % 5 = 0 THEN true ELSE orphans END AS orphans
  FROM sources JOIN p ON preset = ['unfiltered', 'minimal', 'lenient', 'balanced', 'strict', 'maximum'][source_id % 6 + 1]"""))
def filter_presets(spark, d):
    """The settings of every source: its preset, changed by its domain, changed by itself."""
    rows = []
    for (k,) in m.sources(spark, d).select("source_id").collect():  # settings are per source and made where jobs are planned
        f = filtering(list(PRESETS)[k % 6], {"max_same_source_type": 3, "protect_orphans": True, "no_such": 1} if k % 5 == 0 else None, {"max_entity_degree": 5} if k % 7 == 0 else None)
        rows.append((k, list(PRESETS)[k % 6], f.evidence_validation_mode, f.max_entity_degree, f.max_same_source_type, f.max_relationship_ratio, f.semantic_dedup_threshold, f.loop_max_entity_count, f.protect_orphans))
    return spark.createDataFrame(rows, "source_id int, preset string, mode string, degree int, same int, ratio double, threshold double, loops int, orphans boolean")


# ---- evidence ------------------------------------------------------------------------------

_EDGES = ".,;:!?\"'()-"


def telling_words(names: Column, least: int = 4) -> Column:
    """Lower-case words of names, marks at their ends off, of ``least`` characters or more."""
    words = F.flatten(F.transform(names, lambda n: F.split(F.lower(n), r"\s+")))
    return F.filter(F.transform(words, lambda w: F.btrim(w, F.lit(_EDGES))), lambda w: F.length(w) >= least)


def repaired_refs(ref: Column, n: Column) -> Column:
    """Sentence numbers of a reference; of one that can't be read, from the least to the largest S-number in it."""
    found = F.transform(F.regexp_extract_all(ref, F.lit("S([0-9]+)"), F.lit(1)), lambda x: x.try_cast("int"))
    low, high = F.array_min(found), F.array_max(found)
    whole = (F.size(found) > 0) & ~F.exists(found, lambda x: x.isNull() | (x < 1)) & (high <= n)
    fits = F.regexp_replace(F.upper(ref), "[ \t]", "").rlike("^(S[0-9]+(-S?[0-9]+)?[,;]?)+$")
    return F.coalesce(t.sentence_refs(ref, n), F.when(~fits & whole, F.sequence(low, high)))


def _evidence(rows: DataFrame, sentences: DataFrame, refs) -> DataFrame:
    """Add _said: the lower-case text of the sentences that a row refers to, null without a sound reference."""
    joined = rows.join(sentences.select("source_id", "sentences"), "source_id", "left")
    at = refs(F.col("sent_ref"), F.size("sentences"))
    said = F.lower(F.array_join(F.transform(at, lambda k: F.get("sentences", k - 1)), " "))
    return joined.withColumn("_said", F.when(F.trim("sent_ref") != "", said)).drop("sentences")


def _names(name: str, aliases: str) -> Column:
    return F.concat(F.array(F.coalesce(F.col(name), F.lit(""))), F.coalesce(F.col(aliases), F.array().cast("array<string>")))


def _named(said: Column, names: Column) -> Column:
    return F.exists(names, lambda n: F.contains(said, F.lower(n)))


def _hinted(said: Column, names: Column, least: int) -> Column:
    """A telling word is said; names without one must be said whole."""
    words = telling_words(names, least)
    return F.when(F.size(words) > 0, F.exists(words, lambda w: F.contains(said, w))).otherwise(_named(said, names))


def entity_evidence(entities: DataFrame, sentences: DataFrame, mode: str = "standard", least: int = 4) -> DataFrame:
    """Add grounded: off takes all, relaxed a sound reference, standard a telling word of the name in it, others the name."""
    return entity_modes(entities, sentences, {"grounded": mode}, least)


def entity_modes(entities: DataFrame, sentences: DataFrame, modes: dict[str, str], least: int = 4) -> DataFrame:
    """Add a column for each of ``modes``, as :func:`entity_evidence` adds grounded; texts are met once for all."""
    rows = _evidence(entities, sentences, t.sentence_refs)
    names, said = _names("name", "aliases"), F.col("_said")
    tests = {"off": F.lit(True), "relaxed": said.isNotNull(), "standard": _hinted(said, names, least)}
    return rows.withColumns({c: F.coalesce(tests.get(mode, _named(said, names)), F.lit(False)) for c, mode in modes.items()}).drop("_said")


def relation_evidence(relations: DataFrame, entities: DataFrame, sentences: DataFrame, mode: str = "standard", least: int = 4) -> DataFrame:
    """Add grounded: strict wants both names, standard both or one and a word of the type, narrative any of the three.

    Ends that are no entity of the source are never grounded, but where the mode asks for no names.
    """
    return relation_modes(relations, entities, sentences, {"grounded": mode}, least)


def relation_modes(relations: DataFrame, entities: DataFrame, sentences: DataFrame, modes: dict[str, str], least: int = 4) -> DataFrame:
    """Add a column for each of ``modes``, as :func:`relation_evidence` adds grounded; texts and entities are met once for all."""
    rows = _evidence(relations, sentences, repaired_refs)
    said = F.col("_said")
    for end in ("source", "target"):
        e = entities.select("source_id", F.col("ordinal").alias(end), F.col("name").alias(f"_{end}"), F.col("aliases").alias(f"_{end}_aliases"), F.lit(True).alias(f"_{end}_known"))
        rows = rows.join(e, ["source_id", end], "left")
    source, target = _names("_source", "_source_aliases"), _names("_target", "_target_aliases")
    a, b = _hinted(said, source, least), _hinted(said, target, least)
    words = F.filter(F.split(F.lower(F.replace(F.coalesce("type", F.lit("")), F.lit("_"), F.lit(" "))), r"\s+"), lambda w: F.length(w) >= least)
    typed = F.exists(words, lambda w: F.contains(said, w))
    known = F.col("_source_known") & F.col("_target_known")
    tests = {
        "off": F.lit(True),
        "relaxed": said.isNotNull(),
        "standard": known & ((a & b) | ((a | b) & typed)),
        "narrative": known & (a | b | typed),
    }
    strict = known & _named(said, source) & _named(said, target)
    return rows.select(*relations.columns, *[F.coalesce(tests.get(mode, strict), F.lit(False)).alias(c) for c, mode in modes.items()])


_PARTS = "list_filter(regexp_split_to_array(upper(regexp_replace(sent_ref, '[ \\t]', '', 'g')), '[,;]'), lambda p: p <> '')"
_LOW = "try_cast(regexp_extract(p, '^S([0-9]+)', 1) AS INTEGER)"
_HIGH = f"coalesce(try_cast(nullif(regexp_extract(p, '^S[0-9]+-S?([0-9]+)$', 1), '') AS INTEGER), {_LOW})"
_SAID = f"""refs AS (SELECT source_id, ordinal, sent_ref, sentences, {_PARTS} AS parts, len(sentences) AS n, list_transform(regexp_extract_all(sent_ref, 'S([0-9]+)', 1), lambda x: CAST(x AS INTEGER)) AS nums FROM rows JOIN sentences USING (source_id)),
  sound AS (SELECT *, len(parts) > 0 AND len(list_filter(parts, lambda p: NOT regexp_matches(p, '^S[0-9]+(-S?[0-9]+)?$') OR {_LOW} < 1 OR {_HIGH} < {_LOW} OR {_HIGH} > n)) = 0 AS fine, len(list_filter(parts, lambda p: NOT regexp_matches(p, '^S[0-9]+(-S?[0-9]+)?$'))) = 0 AS readable FROM refs),
  placed AS (SELECT source_id, ordinal, sentences, CASE WHEN fine THEN list_sort(list_distinct(flatten(list_transform(parts, lambda p: range({_LOW}, {_HIGH} + 1))))) WHEN repair AND NOT readable AND len(nums) > 0 AND list_min(nums) >= 1 AND list_max(nums) <= n THEN range(list_min(nums), list_max(nums) + 1) END AS refs FROM sound, how),
  said AS (SELECT source_id, ordinal, CASE WHEN refs IS NOT NULL THEN lower(array_to_string(list_transform(refs, lambda k: sentences[k]), ' ')) END AS said FROM placed)"""
_WORDS = "list_filter(list_transform(flatten(list_transform({names}, lambda x: regexp_split_to_array(lower(x), '\\s+'))), lambda w: trim(w, '.,;:!?\"''()-')), lambda w: length(w) >= 4)"
_NAMED = "len(list_filter({names}, lambda x: contains(said, lower(x)))) > 0"


def _hint(names: str) -> str:
    words = _WORDS.format(names=names)
    return f"CASE WHEN len({words}) > 0 THEN len(list_filter({words}, lambda w: contains(said, w))) > 0 ELSE {_NAMED.format(names=names)} END"


_MINE = "([name] || aliases)"


@query("ent_evidence", sql(f"WITH rows AS (SELECT * FROM mentions), how AS (SELECT false AS repair), {_SAID} SELECT r.ordinal, said IS NOT NULL AS relaxed, coalesce({_hint(_MINE)}, false) AS standard, coalesce({_NAMED.format(names=_MINE)}, false) AS strict FROM rows r LEFT JOIN said USING (source_id, ordinal)"))
def ent_evidence(spark, d):
    """Each entity under each mode; off takes all and narrative is strict for entities."""
    e, s = m.mentions(spark, d), m.sentences(spark, d)
    modes = ("relaxed", "standard", "strict")
    return entity_modes(e, s, {x: x for x in modes}).select("ordinal", *modes)


_A, _B = "([a.name] || a.aliases)", "([b.name] || b.aliases)"
_TYPED = "len(list_filter(regexp_split_to_array(lower(replace(r.type, '_', ' ')), '\\s+'), lambda w: length(w) >= 4 AND contains(said, w))) > 0"


@query("rel_evidence", sql(f"""WITH rows AS (SELECT * FROM claims), how AS (SELECT true AS repair), {_SAID}, f AS (SELECT r.ordinal, said IS NOT NULL AS relaxed, {_hint(_A)} AS ha, {_hint(_B)} AS hb, {_NAMED.format(names=_A)} AS na, {_NAMED.format(names=_B)} AS nb, {_TYPED} AS ty
  FROM rows r LEFT JOIN said USING (source_id, ordinal) LEFT JOIN mentions a ON a.source_id = r.source_id AND a.ordinal = r.source LEFT JOIN mentions b ON b.source_id = r.source_id AND b.ordinal = r.target)
  SELECT ordinal, relaxed, coalesce((ha AND hb) OR ((ha OR hb) AND ty), false) AS standard, coalesce(ha OR hb OR ty, false) AS narrative, coalesce(na AND nb, false) AS strict FROM f"""))
def rel_evidence(spark, d):
    """Each relationship under each mode."""
    r, e, s = m.claims(spark, d), m.mentions(spark, d), m.sentences(spark, d)
    modes = ("relaxed", "standard", "narrative", "strict")
    return relation_modes(r, e, s, {x: x for x in modes}).select("ordinal", *modes)


# ---- validity ------------------------------------------------------------------------------


def valid_relations(relations: DataFrame, entities: DataFrame, allow_loops: bool = False) -> DataFrame:
    """Relationships whose ends (ordinals, names or aliases as text) are entities of their source; ends become ordinals.

    Names are found whatever the case, a name before an alias and the first entity before later ones.
    """
    names = entities.select("source_id", F.lower(F.trim("name")).alias("key"), F.lit(0).alias("rank"), "ordinal")
    aliases = entities.select("source_id", F.explode("aliases").alias("key"), "ordinal").select("source_id", F.lower(F.trim("key")).alias("key"), F.lit(1).alias("rank"), "ordinal")
    numbers = entities.select("source_id", F.col("ordinal").cast("string").alias("key"), F.lit(-1).alias("rank"), "ordinal")
    found = names.unionByName(aliases).unionByName(numbers).where("key <> ''").groupBy("source_id", "key").agg(F.min(F.struct("rank", "ordinal")).alias("best"))
    out = relations
    for end in ("source", "target"):
        mine = found.select("source_id", F.col("key").alias("_key"), F.col("best.ordinal").alias("_found"))
        out = out.withColumn("_key", F.lower(F.trim(F.col(end).cast("string")))).join(mine, ["source_id", "_key"]).drop("_key", end).withColumnRenamed("_found", end)
    out = out if allow_loops else out.where("source <> target")
    return out.select(*relations.columns)


@query("rel_validate", sql("""WITH r AS (SELECT source_id, ordinal, CASE WHEN ordinal % 4 = 0 THEN (SELECT any_value(upper(name)) FROM mentions e WHERE e.ordinal = c.source) WHEN ordinal % 4 = 1 THEN 'no such name' ELSE CAST(source AS VARCHAR) END AS s, CAST(target AS VARCHAR) AS t FROM claims c),
  keys AS (SELECT source_id, lower(trim(name, ' ')) AS key, 0 AS rank, ordinal FROM mentions UNION ALL SELECT source_id, lower(trim(a, ' ')), 1, ordinal FROM (SELECT source_id, unnest(aliases) AS a, ordinal FROM mentions) UNION ALL SELECT source_id, CAST(ordinal AS VARCHAR), -1, ordinal FROM mentions),
  best AS (SELECT source_id, key, arg_min(ordinal, (rank, ordinal)) AS o FROM keys WHERE key <> '' GROUP BY 1, 2)
  SELECT r.ordinal, a.o AS source, b.o AS target FROM r JOIN best a ON a.source_id = r.source_id AND a.key = lower(r.s) JOIN best b ON b.source_id = r.source_id AND b.key = lower(r.t) WHERE a.o <> b.o"""))
def rel_validate(spark, d):
    """A quarter of the relationships names its source, a quarter names none that exists."""
    e, c = m.mentions(spark, d), m.claims(spark, d)
    names = e.select("source_id", F.col("ordinal").alias("source"), F.upper("name").alias("_name"))
    k = F.pmod("ordinal", F.lit(4))
    r = c.join(names, ["source_id", "source"]).select("source_id", "ordinal", F.when(k == 0, F.col("_name")).when(k == 1, "no such name").otherwise(F.col("source").cast("string")).alias("source"), F.col("target").cast("string").alias("target"))
    return valid_relations(r, e).select("ordinal", "source", "target")


# ---- types of relationships ----------------------------------------------------------------


def constrained(relations: DataFrame, entities: DataFrame, rules: DataFrame, strict: bool = False, correct: bool = True) -> DataFrame:
    """Relationships with matched (exact, fuzzy, none) and action (kept, swapped, fell_through, dropped), dropped ones too.

    A type is matched to a rule (name, source_types, target_types; empty lists take any type) by its name, else by one name holding the other, the longest
    first, else by a shared word of four letters, the most first; it then takes the rule's name. Ends that fit only turned around are turned, or dropped
    if ``correct`` is off. What fits no rule, or no way around, falls through; with ``strict`` it is dropped, as are ends without a type.
    """
    kind = lambda c: F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[\s-]+", "_")
    types = relations.select(F.col("type").alias("_type")).distinct()
    mine, theirs = kind(F.col("_type")), kind(F.col("name"))
    words = lambda c: F.array_distinct(F.filter(F.split(c, "_"), lambda w: F.length(w) >= 4))
    shared = F.size(F.array_intersect(words(mine), words(theirs)))
    held = (mine != "") & (F.contains(mine, theirs) | F.contains(theirs, mine))
    quality = F.when(mine == theirs, F.struct(F.lit(0), F.lit(0))).when(held, F.struct(F.lit(1), -F.length(theirs))).when(shared > 0, F.struct(F.lit(2), -shared))
    matches = (
        types.join(few(rules), quality.isNotNull())  # rules are a domain's, distinct types few
        .groupBy("_type")
        .agg(F.min(F.struct(quality.alias("quality"), "name", "source_types", "target_types")).alias("rule"))
    )
    e = entities.select("source_id", "ordinal", F.lower(F.trim(F.coalesce("type", F.lit("")))).alias("_kind"))
    rows = relations.join(matches, F.col("type").eqNullSafe(F.col("_type")), "left")
    for end in ("source", "target"):
        rows = rows.join(e.select("source_id", F.col("ordinal").alias(end), F.col("_kind").alias(f"_{end}")), ["source_id", end], "left")
    takes = lambda kinds, k: (F.size(kinds) == 0) | F.array_contains(F.transform(kinds, lambda x: F.lower(x)), k)
    a, b = F.coalesce("_source", F.lit("")), F.coalesce("_target", F.lit(""))
    fits = takes(F.col("rule.source_types"), a) & takes(F.col("rule.target_types"), b)
    turned = takes(F.col("rule.source_types"), b) & takes(F.col("rule.target_types"), a)
    misfit = F.lit("dropped" if strict else "fell_through")
    action = F.when(F.col("rule").isNull() | (a == "") | (b == ""), misfit).when(fits, "kept").when(turned, "swapped" if correct else "dropped").otherwise(misfit)
    matched = F.when(F.col("rule").isNull(), "none").when(F.col("rule.quality.col1") == 0, "exact").otherwise("fuzzy")
    swap = action == "swapped"
    put = {"type": F.coalesce("rule.name", "type"), "source": F.when(swap, F.col("target")).otherwise(F.col("source")), "target": F.when(swap, F.col("source")).otherwise(F.col("target"))}
    return rows.select(*[put.get(c, F.col(c)).alias(c) for c in relations.columns], matched.alias("matched"), action.alias("action"))


_RULES = [("works_for", ["Person"], ["Place", "Object"]), ("lives_in", ["Person"], ["Place"]), ("member_of_place", ["Person", "Item"], ["Place"]), ("owner_of", [], ["Item", "Object"])]
_RULES_SQL = "rules(name, st, tt) AS (VALUES ('works_for', ['person'], ['place', 'object']), ('lives_in', ['person'], ['place']), ('member_of_place', ['person', 'item'], ['place']), ('owner_of', CAST([] AS VARCHAR[]), ['item', 'object']))"


def _constrained_sql(strict: bool) -> str:
    miss = "'dropped'" if strict else "'fell_through'"
    return sql(f"""WITH {_RULES_SQL}, ty AS (SELECT DISTINCT type FROM claims), q AS (SELECT type, name, st, tt, CASE WHEN type = name THEN (0, 0) WHEN contains(type, name) OR contains(name, type) THEN (1, -length(name)) WHEN len(list_intersect(list_filter(string_split(type, '_'), lambda w: length(w) >= 4), list_filter(string_split(name, '_'), lambda w: length(w) >= 4))) > 0
    THEN (2, -len(list_intersect(list_filter(string_split(type, '_'), lambda w: length(w) >= 4), list_filter(string_split(name, '_'), lambda w: length(w) >= 4)))) END AS qu FROM ty, rules),
    best AS (SELECT type, name, st, tt, qu FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY qu, name) AS k FROM q WHERE qu IS NOT NULL) WHERE k = 1),
    j AS (SELECT c.ordinal, c.source, c.target, coalesce(best.name, c.type) AS type, best.name, qu, lower(a.type) AS x, lower(b.type) AS y, st, tt FROM claims c LEFT JOIN best ON best.type = c.type LEFT JOIN mentions a ON a.source_id = c.source_id AND a.ordinal = c.source LEFT JOIN mentions b ON b.source_id = c.source_id AND b.ordinal = c.target),
    f AS (SELECT *, CASE WHEN name IS NULL THEN 'none' WHEN qu = (0, 0) THEN 'exact' ELSE 'fuzzy' END AS matched, CASE WHEN name IS NULL OR x IS NULL OR y IS NULL THEN {miss} WHEN (len(st) = 0 OR list_contains(st, x)) AND (len(tt) = 0 OR list_contains(tt, y)) THEN 'kept' WHEN (len(st) = 0 OR list_contains(st, y)) AND (len(tt) = 0 OR list_contains(tt, x)) THEN {"'dropped'" if strict else "'swapped'"} ELSE {miss} END AS action FROM j)
    SELECT ordinal, CASE WHEN action = 'swapped' THEN target ELSE source END AS source, CASE WHEN action = 'swapped' THEN source ELSE target END AS target, type, matched, action FROM f""")


def _constrained(spark, d, **how) -> DataFrame:
    rules = spark.createDataFrame(_RULES, "name string, source_types array<string>, target_types array<string>")
    return constrained(m.claims(spark, d), m.mentions(spark, d), rules, **how).select("ordinal", "source", "target", "type", "matched", "action")


@query("rel_type_constraints", _constrained_sql(False))
def rel_type_constraints(spark, d):
    """Lenient, turning ends around."""
    return _constrained(spark, d)


@query("rel_type_constraints_strict", _constrained_sql(True))
def rel_type_constraints_strict(spark, d):
    """Strict, dropping what stands the wrong way around."""
    return _constrained(spark, d, strict=True, correct=False)


# ---- limits --------------------------------------------------------------------------------


def limited(relations: DataFrame, entities: DataFrame, degree: int = 25, same: int = 12, ratio: float = 8.0, protect: bool = False) -> DataFrame:
    """(source_id, ordinal, outcome) of each relationship: kept, or the limit it fell to.

    The most confident go first, unknown confidence last: each end may have ``degree`` relationships, a source entity ``same`` of one type, a source ``ratio`` times its entities.
    ``protect`` keeps one that an end with fewer than two would lose.

    Each choice rests on those before it at its ends and in its type, and on nothing else, so they are made in parallel: what is kept before a relationship
    lies between what is known to be kept and that with what is still open. Once these bounds agree on a limit it is decided; the first open one at both ends always
    is. The ratio is a running count over all that the other limits let through.
    """
    spark, spent = relations.sparkSession, []
    counts = entities.groupBy("source_id").agg(F.count("*").alias("_entities"))
    rows = relations.select("source_id", "ordinal", "source", "target", "type", F.coalesce(-F.col("confidence"), F.lit(float("inf"))).alias("_rank"))
    most = (F.lit(float(ratio)) * F.coalesce("_entities", F.lit(0))).cast("bigint")
    edges, path = materialise_at(rows.join(counts, "source_id", "left").select(*rows.columns, most.alias("_most"), F.monotonically_increasing_id().alias("_edge")), "edges")
    spent.append(path)
    # an edge stands at each of its ends, a self loop once with double weight, and in its type
    ends = F.transform(F.array_distinct(F.array("source", "target")), lambda v: F.struct(F.lit(0).alias("kind"), v.alias("node"), F.lit(None).cast("string").alias("of"), F.when(F.col("source").eqNullSafe(F.col("target")), 2).otherwise(1).alias("weight")))
    typed = F.struct(F.lit(1).alias("kind"), F.col("source").alias("node"), F.col("type").cast("string").alias("of"), F.lit(1).alias("weight"))
    at = edges.select("source_id", "_rank", "ordinal", "_edge", F.posexplode(F.array_append(ends, typed)).alias("_one", "at")).select("source_id", "_rank", "ordinal", "_edge", (F.col("_one") == 0).alias("_one"), "at.*")
    key, order = ["source_id", "kind", "node", "of"], ["_rank", "ordinal", "_edge"]
    largest = {r.kind: r.most for r in at.groupBy(*key).agg(F.sum("weight").alias("n")).groupBy("kind").agg(F.max("n").alias("most")).collect()}  # two rows
    decided = []
    if largest.get(0, 0) > degree or largest.get(1, 0) > same:
        binding = [kind for kind, limit in ((0, degree), (1, same)) if largest[kind] > limit]
        if 0 not in binding:
            at = at.withColumn("_one", F.lit(True))  # an edge's only row is that of its type
        groups = Ordered(at.where(F.col("kind").isin(*binding)), key, order, spent)
        now = groups.rows.withColumns({"state": F.lit(0), "label": F.lit(None).cast("string")})
        few = min(2, degree)
        while True:
            kept, open_ = F.col("state") == 1, F.col("state") == 0
            seen = groups.before(now, {"lo": F.when(kept, F.col("weight")).otherwise(0), "hi": F.when(kept | open_, F.col("weight")).otherwise(0)})
            edge = Window.partitionBy("_edge")
            of = lambda kind, c, how: F.coalesce(how(F.when(F.col("kind") == kind, F.col(c))).over(edge), F.lit(0))
            seen = seen.select(*now.columns, *[of(0, c, how).alias(f"{n}_{c}") for c in ("lo", "hi") for n, how in (("most", F.max), ("least", F.min))], of(1, "lo", F.max).alias("type_lo"), of(1, "hi", F.max).alias("type_hi"))
            full, spare = F.col("most_lo") >= degree, F.col("most_hi") < degree
            if protect:
                full, spare = full & (F.col("least_lo") >= few), spare | (F.col("least_hi") < few)
            state = F.when(~open_, F.col("state")).when((F.col("type_hi") < same) & spare, 1).when((F.col("type_lo") >= same) | full, 2).otherwise(0)
            label = F.when(F.col("_state") == 1, "kept").when(F.col("_state") == 2, F.when(F.col("type_lo") >= same, "same_type").when(F.col("type_hi") < same, "degree"))
            after, path = materialise_at(seen.withColumn("_state", state).withColumn("label", label).select(*[F.col("_state").alias("state") if c == "state" else F.col(c) for c in now.columns]), "limits")
            spent.append(path)
            decided.append(after.where("_one and label <> 'kept'").select("_edge", "label"))
            now = after.where("label is null or label = 'kept'")
            if after.where("label is null").isEmpty():
                break
    if decided:
        lost = reduce(DataFrame.unionByName, decided)
        edges = edges.join(lost, "_edge", "left").withColumn("label", F.coalesce("label", F.lit("kept")))
    else:
        edges = edges.withColumn("label", F.lit("kept"))
    sources = Ordered(edges.select("source_id", *order, "label", "_most"), ["source_id"], order, spent)
    done = sources.before(sources.rows, {"_kept": F.when(F.col("label") == "kept", 1).otherwise(0)})
    out, _ = materialise_at(done.select("source_id", "ordinal", F.when(F.col("_kept") >= F.col("_most"), "ratio").otherwise(F.col("label")).alias("outcome")), "limited")
    for path in spent:
        discard(spark, path)
    return out


@query("rel_limits", sql("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY source_id, source, type ORDER BY confidence DESC, ordinal) AS k FROM claims), n AS (SELECT source_id, count(*) AS n FROM mentions GROUP BY 1),
  t AS (SELECT *, CASE WHEN k <= 1 THEN row_number() OVER (PARTITION BY source_id, k <= 1 ORDER BY confidence DESC, ordinal) END AS r FROM c)
  SELECT ordinal, CASE WHEN k > 1 AND (SELECT count(*) FROM t x WHERE x.source_id = t.source_id AND x.r IS NOT NULL AND (x.confidence > t.confidence OR (x.confidence = t.confidence AND x.ordinal < t.ordinal))) < n.n / 2 THEN 'same_type' WHEN k > 1 OR r > n.n / 2 THEN 'ratio' ELSE 'kept' END AS outcome FROM t JOIN n USING (source_id)""".replace("n.n / 2", "n.n // 2")))
def rel_limits(spark, d):
    """One relationship of a type from an entity, half as many as entities in all; degrees bind only in rel_limits_degree."""
    return limited(m.claims(spark, d), m.mentions(spark, d), degree=1000, same=1, ratio=0.5).select("ordinal", "outcome")


@query("rel_limits_degree")
def rel_limits_degree(spark, d):
    """All three limits, tight, with orphans protected; tested against a plain loop."""
    return limited(m.claims(spark, d), m.mentions(spark, d), degree=3, same=2, ratio=1.0, protect=True).select("ordinal", "outcome")


# ---- types and structure of entities -------------------------------------------------------

_NUMBER = "([0-9]+|[ivxlcdm]+|one|two|three|four|five|six|seven|eight|nine|ten)"
# Names of what structures a document rather than being in it, and the types of such entities.
STRUCTURAL_NAMES = (rf"chapter\s+{_NUMBER}", r"section\s+[0-9A-Za-z_.]+", rf"part\s+{_NUMBER}", rf"book\s+{_NUMBER}", r"appendix\s+[0-9A-Za-z_]+", r"(figure|table|exhibit)\s+[0-9.]+", r"(page|p\.?)\s*[0-9]+", r"(volume|vol\.?)\s+([0-9]+|[ivxlcdm]+)")
STRUCTURAL = "(?i)^(" + "|".join(STRUCTURAL_NAMES) + ")$"
STRUCTURAL_TYPES = ("STRUCTURAL_UNIT", "Structural Unit", "structural_unit", "DOCUMENT_SECTION", "Document Section", "CHAPTER", "Chapter", "SECTION", "Section")
GENERIC = ("Item", "UNKNOWN", "Unknown", "Thing", "Object", "Entity", "Concept")


def without_ends(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relationships whose ends are both among ``entities``."""
    for end in ("source", "target"):
        relations = relations.join(entities.select("source_id", F.col("ordinal").alias(end)), ["source_id", end], "left_semi")
    return relations


def without_structure(entities: DataFrame, relations: DataFrame, types: tuple[str, ...] = STRUCTURAL_TYPES) -> tuple[DataFrame, DataFrame]:
    """Entities that aren't chapters, pages and the like by type or name, and the relationships left between them."""
    structural = F.coalesce(F.col("type").isin(*types), F.lit(False)) | F.trim(F.coalesce("name", F.lit(""))).rlike(STRUCTURAL)
    kept = entities.where(~structural)
    return kept, without_ends(relations, kept)


_SQL_STRUCTURAL = STRUCTURAL.replace("'", "''")


@query("ent_structural", sql(f"""WITH kept AS (SELECT source_id, ordinal FROM mentions WHERE NOT (type = 'Title' OR regexp_matches(trim(name, ' '), '{_SQL_STRUCTURAL}')))
  SELECT source_id, count(DISTINCT k.ordinal) AS entities, CAST((SELECT count(*) FROM claims c WHERE c.source_id = k.source_id AND c.source IN (SELECT ordinal FROM kept) AND c.target IN (SELECT ordinal FROM kept)) AS BIGINT) AS relations FROM kept k GROUP BY source_id"""))
def ent_structural(spark, d):
    e, r = without_structure(m.mentions(spark, d), m.claims(spark, d), ("Title",))
    return e.groupBy("source_id").agg(F.count("*").alias("entities")).join(r.groupBy("source_id").agg(F.count("*").alias("relations")), "source_id", "left").fillna(0, ["relations"])


def aliased_types(entities: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Types under their canonical names, matched exactly; entity_subtype keeps the first name that a type had."""
    new = F.try_element_at(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]), F.col("type")) if aliases else F.lit(None)
    before = F.col("entity_subtype") if "entity_subtype" in entities.columns else F.lit(None).cast("string")
    changed = new.isNotNull() & (new != F.col("type"))
    return entities.withColumns({"entity_subtype": F.when(changed, F.coalesce(before, "type")).otherwise(before), "type": F.when(changed, new).otherwise(F.col("type"))})


@query("ent_type_alias", sql("SELECT ordinal, CASE type WHEN 'person' THEN 'Person' WHEN 'Object' THEN 'Item' ELSE type END AS type, CASE WHEN type IN ('person', 'Object') THEN type END AS entity_subtype FROM mentions"))
def ent_type_alias(spark, d):
    return aliased_types(m.mentions(spark, d), {"person": "Person", "Object": "Item"}).select("ordinal", "type", "entity_subtype")


def _first_rule(rules: dict[str, list[str]], hit) -> Column:
    """The name of the first rule with a keyword that ``hit`` finds, else null."""
    out = F.lit(None).cast("string")
    for name, keywords in reversed(list(rules.items())):
        test = F.lit(False)
        for k in keywords:
            test = test | hit(k.lower())
        out = F.when(test, name).otherwise(out)
    return out


def normal_types(entities: DataFrame, rules: dict[str, list[str]], generic: tuple[str, ...] = GENERIC) -> DataFrame:
    """Generic types by the first rule with a keyword in the description; type_normalized_from keeps the old one."""
    said = F.lower(F.coalesce("description", F.lit("")))
    new = F.when(F.coalesce("type", F.lit("")).isin(*generic), _first_rule(rules, lambda k: F.contains(said, F.lit(k))))
    return entities.withColumns({"type_normalized_from": F.when(new.isNotNull(), F.col("type")), "type": F.coalesce(new, "type")})


@query("ent_type_normalize", sql("SELECT ordinal, coalesce(t, type) AS type, CASE WHEN t IS NOT NULL THEN type END AS type_normalized_from FROM (SELECT ordinal, type, CASE WHEN type NOT IN ('Item', 'Unknown', 'Object') THEN NULL WHEN contains(lower(description), 'place near') OR contains(lower(description), 'town') THEN 'Place' WHEN contains(lower(description), 'called') THEN 'Person' END AS t FROM mentions)"))
def ent_type_normalize(spark, d):
    return normal_types(m.mentions(spark, d), {"Place": ["Place near", "town"], "Person": ["called"]}).select("ordinal", "type", "type_normalized_from")


# Single words that name nothing.
COMMON = ("the", "a", "an", "it", "is", "was", "were", "be", "been", "and", "or", "but", "not", "no", "yes", "he", "she", "they", "him", "her", "his", "this", "that", "these", "those", "who", "what", "where", "when", "how", "why")


def rescued_types(entities: DataFrame, relations: DataFrame, valid: list[str], rules: dict[str, list[str]], absorb: dict[str, tuple[str, str]]) -> DataFrame:
    """Entities with action (valid, junk, absorbed, remapped, dropped), type, type_rescued_from, and absorber, the entity that takes one as a property.

    Of invalid types, names that are empty, common words or their own type are junk. A type in ``absorb`` (type to (target type, property)) becomes a property of
    an entity of that type: the first related one, else the nearest within three places of the same chunk, the earlier first. Else the first rule
    whose target is valid and one of whose keywords the description or the type name holds (or is held by) gives the type. The rest is dropped.
    """
    kind, name = F.trim(F.coalesce("type", F.lit(""))), F.trim(F.coalesce("name", F.lit("")))
    e = entities.withColumn("_place", F.row_number().over(Window.partitionBy("source_id").orderBy("ordinal")))
    invalid = ~F.lower(kind).isin(*[v.lower() for v in valid])
    junk = (name == "") | (F.lower(name) == F.lower(kind)) | F.lower(name).isin(*COMMON)
    target = F.try_element_at(F.create_map(*[F.lit(x) for k, (to, _) in absorb.items() for x in (k, to)]), kind) if absorb else F.lit(None).cast("string")
    wanting = e.where(invalid & ~junk).select("source_id", "ordinal", "_place", "chunk_index", F.lower(target).alias("_target")).where("_target is not null")
    hosts = e.select("source_id", F.col("ordinal").alias("_host"), F.col("_place").alias("_at"), F.col("chunk_index").alias("_chunk"), F.lower(kind).alias("_kind"))
    ends = relations.select("source_id", F.explode(F.array(F.struct(F.col("source").alias("ordinal"), F.col("target").alias("_host")), F.struct(F.col("target").alias("ordinal"), F.col("source").alias("_host")))).alias("x")).select("source_id", "x.*").distinct()
    related = wanting.join(ends, ["source_id", "ordinal"]).join(hosts, ["source_id", "_host"]).where("_kind = _target").select("source_id", "ordinal", F.struct(F.lit(0).alias("way"), F.lit(0).alias("far"), F.col("_host").alias("host")).alias("found"))
    around = wanting.withColumn("_at", F.explode(F.array(*[F.col("_place") + k for k in (-3, -2, -1, 1, 2, 3)])))
    near = around.join(hosts, ["source_id", "_at"]).where(F.col("_chunk").eqNullSafe(F.col("chunk_index")) & (F.col("_kind") == F.col("_target")))
    near = near.select("source_id", "ordinal", F.struct(F.lit(1).alias("way"), F.abs(F.col("_at") - F.col("_place")).cast("int").alias("far"), F.col("_host").alias("host")).alias("found"))
    best = related.unionByName(near).groupBy("source_id", "ordinal").agg(F.min("found").alias("found"))
    said, low = F.lower(F.coalesce("description", F.lit(""))), F.lower(kind)
    usable = {k: v for k, v in rules.items() if k in valid}
    new = _first_rule(usable, lambda k: F.contains(said, F.lit(k)) | F.contains(F.lit(k), low) | F.contains(low, F.lit(k)))
    joined = e.join(best, ["source_id", "ordinal"], "left")
    action = F.when(~invalid, "valid").when(junk, "junk").when(F.col("found").isNotNull(), "absorbed").when(new.isNotNull(), "remapped").otherwise("dropped")
    put = {"type": F.when(action == "remapped", new).otherwise(F.col("type"))}
    return joined.select(
        *[put.get(c, F.col(c)).alias(c) for c in entities.columns],
        action.alias("action"), F.when(action == "remapped", kind).alias("type_rescued_from"), F.when(action == "absorbed", F.col("found.host")).alias("absorber"),
    )


@query("ent_type_rescue", sql(f"""WITH e AS (SELECT *, lower(type) AS k, row_number() OVER (PARTITION BY source_id ORDER BY ordinal) AS place FROM mentions), ends AS (SELECT source_id, source AS o, target AS h FROM claims UNION SELECT source_id, target, source FROM claims),
  bad AS (SELECT *, lower(name) = k OR lower(name) IN ({", ".join(f"'{w}'" for w in COMMON)}) AS junk FROM e WHERE k NOT IN ('person', 'place')),
  found AS (SELECT b.source_id, b.ordinal, 0 AS way, 0 AS far, h.ordinal AS host FROM bad b JOIN ends x ON x.source_id = b.source_id AND x.o = b.ordinal JOIN e h ON h.source_id = b.source_id AND h.ordinal = x.h AND h.k = 'person' WHERE b.type = 'Title' AND NOT junk
    UNION ALL SELECT b.source_id, b.ordinal, 1, abs(h.place - b.place), h.ordinal FROM bad b JOIN e h ON h.source_id = b.source_id AND h.k = 'person' AND h.chunk_index = b.chunk_index AND abs(h.place - b.place) BETWEEN 1 AND 3 WHERE b.type = 'Title' AND NOT junk),
  best AS (SELECT source_id, ordinal, arg_min(host, (way, far, host)) AS host FROM found GROUP BY 1, 2),
  new AS (SELECT e.ordinal, e.type, e.k, b.junk, f.host, CASE WHEN contains(coalesce(lower(e.description), ''), 'someone') OR contains('someone', e.k) OR contains(e.k, 'someone') THEN 'Person' WHEN contains(coalesce(lower(e.description), ''), 'place near') OR contains('place near', e.k) OR contains(e.k, 'place near') THEN 'Place' END AS n
    FROM e LEFT JOIN bad b ON b.source_id = e.source_id AND b.ordinal = e.ordinal LEFT JOIN best f ON f.source_id = e.source_id AND f.ordinal = e.ordinal),
  act AS (SELECT *, CASE WHEN junk IS NULL THEN 'valid' WHEN junk THEN 'junk' WHEN host IS NOT NULL THEN 'absorbed' WHEN n IS NOT NULL THEN 'remapped' ELSE 'dropped' END AS action FROM new)
  SELECT ordinal, action, CASE WHEN action = 'remapped' THEN n ELSE type END AS type, CASE WHEN action = 'remapped' THEN type END AS type_rescued_from, CASE WHEN action = 'absorbed' THEN host END AS absorber FROM act"""))
def ent_type_rescue(spark, d):
    found = rescued_types(m.mentions(spark, d), m.claims(spark, d), ["Person", "Place"], {"Person": ["someone"], "Place": ["place near"], "Ghost": ["called"]}, {"Title": ("Person", "title")})
    return found.select("ordinal", "action", "type", "type_rescued_from", "absorber")


# ---- plausibility, exclusions --------------------------------------------------------------


def spoken_words(texts: DataFrame) -> DataFrame:
    """(source_id, word, inside): the distinct words of each source as written; ``inside`` marks those that it has behind a small letter, number, comma or semicolon and a blank."""
    all_of = lambda pattern: F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(0)))
    flagged = lambda words, flag: F.transform(words, lambda w: F.struct(w.alias("word"), F.lit(flag).alias("inside")))
    every = F.concat(flagged(all_of(r"[\p{L}\p{N}]+"), False), flagged(all_of(r"(?<=[\p{Ll}\p{N},;] )[\p{L}\p{N}]+"), True))
    return texts.select("source_id", F.explode(every).alias("w")).select("source_id", "w.*").distinct()


def plausible(
    entities: DataFrame, texts: DataFrame, named: tuple[str, ...] | None = None, least: float = 0.30, least_other: float = 0.15, visual: str | None = None, visual_factor: float = 0.5
) -> DataFrame:
    """Add plausibility and kept: the share of a name's telling words that its source writes with a capital inside a sentence.

    A word that the source doesn't have, or has only where a sentence begins, neither grounds nor counts against the name. Types in ``named`` (null: all) must reach
    ``least``, others ``least_other``, where the column ``visual`` is true ``visual_factor`` times that; only words that never have a capital take away. A name without words scores 0.

    A text is read once, for its distinct words; names meet them word by word, so no text travels to its entities.
    """
    base = materialise(entities.withColumn("_row", F.monotonically_increasing_id()), "entities")
    words = F.filter(F.split(F.trim(F.coalesce("name", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & (F.lower(w) != "the"))
    each = base.select("_row", "source_id", F.posexplode(words).alias("place", "w"))
    capital = F.concat(F.upper(F.substring("w", 1, 1)), F.lower(F.substring("w", F.lit(2), F.length("w"))))
    asked = each.select("_row", "source_id", "place", F.explode(F.array(F.struct(capital.alias("word"), F.lit(True).alias("inside")), F.struct(F.lower("w").alias("word"), F.lit(False).alias("inside")))).alias("a")).select("_row", "source_id", "place", "a.*")
    met = asked.join(spoken_words(texts).withColumn("said", F.lit(True)), ["source_id", "word", "inside"], "left")
    marked = met.groupBy("_row", "place").agg(F.max(F.when(F.col("said"), F.when(F.col("inside"), 1.0).otherwise(0.0))).alias("mark"))
    scored = marked.groupBy("_row").agg(F.coalesce(F.round(F.avg("mark"), 4), F.lit(1.0)).alias("plausibility"))
    bound = F.lit(least) if named is None else F.when(F.coalesce("type", F.lit("")).isin(*named), least).otherwise(least_other)
    if visual:
        bound = bound * F.when(F.coalesce(F.col(visual), F.lit(False)), visual_factor).otherwise(1.0)
    out = base.join(scored, "_row", "left").withColumn("plausibility", F.coalesce("plausibility", F.lit(0.0)))
    return out.withColumn("kept", F.col("plausibility") >= bound).drop("_row")


_TEXT_WORDS = r"""said AS MATERIALIZED (SELECT DISTINCT source_id, word, inside FROM (SELECT doc_id AS source_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS word, false AS inside FROM documents
  UNION ALL SELECT doc_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(replace(text, '^', '*'), '([\p{Ll}\p{N},;]) ([\p{L}\p{N}])', '\1 ^\2', 'g'), '([\p{Ll}\p{N},;]) ([\p{L}\p{N}])', '\1 ^\2', 'g'), '\^([\p{L}\p{N}]+)', 1)), true FROM documents))"""


@query("ent_plausibility", sql(f"""WITH {_TEXT_WORDS}, n AS (SELECT ordinal, source_id, type, list_filter(regexp_split_to_array(trim(name, ' '), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' AND lower(w) <> 'the') AS w FROM mentions),
  e AS (SELECT ordinal, source_id, i, upper(w[i][1]) || lower(w[i][2:]) AS big, lower(w[i]) AS small FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM n)),
  k AS (SELECT ordinal, CASE WHEN EXISTS (SELECT 1 FROM said s WHERE s.source_id = e.source_id AND s.word = e.big AND s.inside) THEN 1.0::DOUBLE WHEN EXISTS (SELECT 1 FROM said s WHERE s.source_id = e.source_id AND s.word = e.small AND NOT s.inside) THEN 0.0::DOUBLE END AS mark FROM e),
  p AS (SELECT ordinal, coalesce(round(avg(mark), 4), 1.0::DOUBLE) AS p FROM k GROUP BY ordinal)
  SELECT n.ordinal, coalesce(p, 0.0::DOUBLE) AS plausibility, coalesce(p, 0.0::DOUBLE) >= CASE WHEN coalesce(type, '') IN ('Person', 'Place') THEN 0.30 ELSE 0.15 END * CASE WHEN n.source_id % 3 = 0 THEN 0.5 ELSE 1 END AS kept FROM n LEFT JOIN p USING (ordinal)"""))
def ent_plausibility(spark, d):
    """Every third source as one of pictures."""
    texts = m.table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), "text")
    seen = m.mentions(spark, d).withColumn("visual", F.col("source_id") % 3 == 0)
    return plausible(seen, texts, ("Person", "Place"), visual="visual").select("ordinal", "plausibility", "kept")


def excluded(entities: DataFrame, rules: list[dict]) -> DataFrame:
    """Entities that no rule drops: a rule names examples, equal whatever the case, or a pattern, for a type or for all."""
    name, out = F.lower(F.trim(F.coalesce("name", F.lit("")))), F.lit(False)
    for rule in rules:
        hit = name.isin(*[e.lower() for e in rule["examples"]])
        if rule.get("pattern"):
            hit = hit | name.rlike(rule["pattern"])
        out = out | (hit & (F.coalesce("type", F.lit("")) == rule["type"]) if rule.get("type") else hit)
    return entities.where(~out)


@query("ent_exclusions", sql("SELECT ordinal FROM mentions WHERE NOT (lower(name) IN ('the', 'chapter 3') OR regexp_matches(lower(name), '^[aeiou]')  AND type = 'Place')"))
def ent_exclusions(spark, d):
    rules = [{"description": "words that name nothing", "examples": ["The", "Chapter 3"]}, {"description": "places by vowel", "examples": ["nowhere"], "pattern": "^[aeiou]", "type": "Place"}]
    return excluded(m.mentions(spark, d), rules).select("ordinal")


# ---- domains -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Domain:
    """How a domain shows in a text. ``keywords`` are groups (terms, weight); terms of up to three letters must stand alone."""

    name: str
    keywords: tuple[tuple[tuple[str, ...], float], ...] = ()
    patterns: tuple[tuple[str, float], ...] = ()
    extensions: tuple[str, ...] = ()
    doc_types: tuple[str, ...] = ()
    base: float = 0.1
    per_keyword: float = 0.05
    per_extension: float = 0.1
    per_doc_type: float = 0.2
    per_pattern: float = 0.15
    least: float = 0.4

    def score(self, text: Column, filename: Column, doc_type: Column) -> Column:
        """Not capped: scores rank domains."""
        one = lambda test, worth: F.when(F.coalesce(test, F.lit(False)), worth).otherwise(0.0)
        low, out = F.lower(text), F.lit(self.base)
        for terms, weight in self.keywords:
            for term in terms:
                hit = F.contains(low, F.lit(term.lower())) if len(term) > 3 else text.rlike(rf"(?i)(^|[^A-Za-z0-9_]){term}([^A-Za-z0-9_]|$)")
                out = out + one(hit, self.per_keyword * weight)
        for pattern, weight in self.patterns:
            out = out + one(text.rlike(pattern), self.per_pattern * weight)
        if self.extensions:
            out = out + one(F.lower(filename).rlike("(" + "|".join(e.replace(".", r"\.") for e in self.extensions) + ")$"), self.per_extension)
        if self.doc_types:
            out = out + one(doc_type.isin(*self.doc_types), self.per_doc_type)
        return F.round(out, 6)


FLOOR, CLEAR = 0.45, 0.6


def ranked_domains(docs: DataFrame, domains: list[Domain], text: str = "text") -> DataFrame:
    """(doc_id, ranking): array of (score, domain) of the domains that reach their own least score, best first, then by name."""
    column = lambda c: F.col(c) if c in docs.columns else F.lit(None).cast("string")
    found = [F.when((s := d.score(F.coalesce(text, F.lit("")), column("filename"), column("doc_type"))) >= d.least, F.struct((-s).alias("minus"), F.lit(d.name).alias("domain"))) for d in domains if d.name != "generic"]
    ranking = F.array_sort(F.filter(F.array(*found), lambda x: x.isNotNull()))
    return docs.select("doc_id", F.transform(ranking, lambda x: F.struct((-x["minus"]).alias("score"), x["domain"].alias("domain"))).alias("ranking"))


def detected(docs: DataFrame, domains: list[Domain], forced: str | None = None, text: str = "text") -> DataFrame:
    """(doc_id, domain, score, low): the best domain, generic with 0.1 where none reaches ``FLOOR``; low below ``CLEAR``. A forced domain has score 1."""
    if forced:
        return docs.select("doc_id", F.lit(forced).alias("domain"), F.lit(1.0).alias("score"), F.lit(False).alias("low"))
    best = ranked_domains(docs, domains, text).withColumn("best", F.get("ranking", F.lit(0)))
    fine = F.coalesce(F.col("best.score") >= FLOOR, F.lit(False))
    score = F.when(fine, F.col("best.score")).otherwise(0.1)
    return best.select("doc_id", F.when(fine, F.col("best.domain")).otherwise("generic").alias("domain"), score.alias("score"), (score < CLEAR).alias("low"))


DOMAINS = [
    Domain("english", keywords=((("the", "of", "and", "tion"), 2.0), (("thing",), 1.0)), patterns=((r"(^|[^A-Za-z])th[a-z]+ing([^A-Za-z]|$)", 1.0),), extensions=(".src1", ".src2")),
    Domain("french", keywords=((("les", "eau", "dans", "est"), 2.0), (("queux",), 1.0)), patterns=((r"(^|[^A-Za-z])[Ll]e [a-z]+", 1.0),), extensions=(".src3",)),
    Domain("german", keywords=((("und", "der", "keit", "ung"), 2.0),), patterns=((r"(^|[^A-Za-z])[A-Z][a-z]+ung([^A-Za-z]|$)", 1.5),), doc_types=("src4", "src5")),
]


def _domain_sql(text: str, filename: str, kind: str) -> list[str]:
    out = []
    for x in DOMAINS:
        parts = [str(x.base)]
        for terms, weight in x.keywords:
            for term in terms:
                hit = f"contains(lower({text}), '{term}')" if len(term) > 3 else f"regexp_matches({text}, '(?i)(^|[^A-Za-z0-9_]){term}([^A-Za-z0-9_]|$)')"
                parts.append(f"CASE WHEN {hit} THEN {x.per_keyword * weight} ELSE 0 END")
        parts += [f"CASE WHEN regexp_matches({text}, '{p}') THEN {x.per_pattern * w} ELSE 0 END" for p, w in x.patterns]
        parts += [f"CASE WHEN ends_with(lower({filename}), '{e}') THEN {x.per_extension} ELSE 0 END" for e in x.extensions]
        if x.doc_types:
            parts.append(f"CASE WHEN {kind} IN ({', '.join(repr(k) for k in x.doc_types)}) THEN {x.per_doc_type} ELSE 0 END")
        out.append(f"CAST(round({' + '.join(parts)}, 6) AS DOUBLE)")
    return out


_SCORES = " UNION ALL ".join(f"SELECT doc_id, '{x.name}' AS domain, {s} AS score, {x.least} AS least FROM docs" for x, s in zip(DOMAINS, _domain_sql("text", "filename", "doc_type"), strict=True))
_PICK = f"""best AS (SELECT doc_id, domain, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, domain) AS k FROM scores WHERE score >= least) WHERE k = 1)
  SELECT d.doc_id, CASE WHEN score >= {FLOOR} THEN domain ELSE 'generic' END AS domain, CAST(CASE WHEN score >= {FLOOR} THEN score ELSE 0.1 END AS DOUBLE) AS score, CASE WHEN score >= {FLOOR} THEN score < {CLEAR} ELSE true END AS low FROM docs d LEFT JOIN best USING (doc_id)"""


@query("domain_detect", f"WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, 'a.' || source AS filename, source AS doc_type FROM documents), scores AS ({_SCORES}), {_PICK}")
def domain_detect(spark, d):
    docs = m.table(spark, d, "documents").select("doc_id", "text", F.concat(F.lit("a."), "source").alias("filename"), F.col("source").alias("doc_type"))
    return detected(docs, DOMAINS)


@query("domain_of_source", f"WITH docs AS (SELECT source AS doc_id, string_agg(left(text, 2000), chr(10) ORDER BY doc_id) AS text, NULL::VARCHAR AS filename, NULL::VARCHAR AS doc_type FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 5 GROUP BY source), scores AS ({_SCORES}), r AS ({_PICK}) SELECT doc_id AS source, CASE WHEN doc_id = 'src7' THEN 'legal' ELSE domain END AS domain, CASE WHEN doc_id = 'src7' THEN 1.0::DOUBLE ELSE score END AS score FROM r".replace("WITH docs", "WITH docs", 1).replace("r AS (best AS", "r AS (WITH best AS"))
def domain_of_source(spark, d):
    """A source's domain, by a sample of its first five texts, two thousand characters of each; one source has a forced domain."""
    w = Window.partitionBy("source").orderBy("doc_id")
    first = m.table(spark, d, "documents").withColumn("k", F.row_number().over(w)).where("k <= 5")
    texts = first.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", F.substring("text", 1, 2000).alias("x")))).alias("parts"))
    sample = texts.select(F.col("source").alias("doc_id"), F.array_join(F.transform("parts", lambda p: p["x"]), "\n").alias("text"))
    forced = F.col("doc_id") == "src7"
    return detected(sample.where(~forced), DOMAINS).unionByName(detected(sample.where(forced), DOMAINS, "legal")).select(F.col("doc_id").alias("source"), "domain", "score")


# ---- citations -----------------------------------------------------------------------------


def citations_of(rows: DataFrame, sentences: DataFrame, kind: str, most: int = 500) -> DataFrame:
    """(source_id, uri, kind, chunk_index, snippet, confidence): a citation per chunk of an entity or relationship, with what its sentences say.

    Rows carry chunk_index or, where they were merged, source_chunk_indices. A reference that can't be read leaves the snippet empty.
    """
    chunks = F.col("source_chunk_indices") if "source_chunk_indices" in rows.columns else F.array("chunk_index")
    joined = rows.withColumn("_chunks", chunks).join(sentences, "source_id", "left")
    at = t.sentence_refs("sent_ref", F.size("sentences"))
    snippet = F.coalesce(F.substring(F.array_join(F.transform(at, lambda k: F.get("sentences", k - 1)), " "), 1, most), F.lit(""))
    return joined.select("source_id", F.concat(F.lit(f"{kind}:"), "ordinal").alias("uri"), F.lit(kind).alias("kind"), F.explode("_chunks").alias("chunk_index"), snippet.alias("snippet"), "confidence")


@query("citation_build", sql(f"""WITH rows AS (SELECT source_id, ordinal * 2 AS ordinal, 'entity:' || ordinal AS uri, 'entity' AS kind, chunk_index, sent_ref, confidence FROM mentions UNION ALL SELECT source_id, ordinal * 2 + 1, 'relation:' || ordinal, 'relation', chunk_index, sent_ref, confidence FROM claims), how AS (SELECT false AS repair), {_SAID.replace("lower(array_to_string(list_transform(refs, lambda k: sentences[k]), ' '))", "array_to_string(list_transform(refs, lambda k: sentences[k]), ' ')")}
  SELECT r.source_id, uri, kind, chunk_index, coalesce(left(said, 500), '') AS snippet, confidence FROM rows r LEFT JOIN said USING (source_id, ordinal)"""))
def citation_build(spark, d):
    """Citations of all entities and relationships of every source."""
    s = m.sentences(spark, d)
    return citations_of(m.mentions(spark, d), s, "entity").unionByName(citations_of(m.claims(spark, d), s, "relation"))


@query("ent_orphan_drop", sql("""WITH linked AS (SELECT source_id, source AS o FROM claims UNION SELECT source_id, target FROM claims), kept AS (SELECT e.source_id, e.ordinal, CAST(row_number() OVER (PARTITION BY e.source_id ORDER BY e.ordinal) - 1 AS INTEGER) AS i FROM mentions e WHERE (e.source_id, e.ordinal) IN (SELECT (source_id, o) FROM linked)),
  gone AS (SELECT source_id, count(*) AS n FROM mentions GROUP BY 1) SELECT c.ordinal, a.i AS source, b.i AS target, CAST(gone.n - (SELECT count(*) FROM kept k WHERE k.source_id = c.source_id) AS BIGINT) AS dropped FROM claims c JOIN kept a ON a.source_id = c.source_id AND a.ordinal = c.source JOIN kept b ON b.source_id = c.source_id AND b.ordinal = c.target JOIN gone ON gone.source_id = c.source_id"""))
def ent_orphan_drop(spark, d):
    """Entities that no relationship touches go; relationships point to the places of those left."""
    e, r = m.mentions(spark, d), m.claims(spark, d)
    linked = r.select("source_id", F.explode(F.array("source", "target")).alias("ordinal")).distinct()
    marked = e.join(linked.withColumn("_linked", F.lit(True)), ["source_id", "ordinal"], "left").withColumn("_linked", F.coalesce("_linked", F.lit(False)))
    kept = marked.where("_linked").select("source_id", "ordinal", (F.row_number().over(Window.partitionBy("source_id").orderBy("ordinal")) - 1).alias("i"))
    gone = marked.groupBy("source_id").agg(F.count_if(~F.col("_linked")).alias("dropped"))
    a, b = (kept.select("source_id", F.col("ordinal").alias(end), F.col("i").alias(f"{end}_i")) for end in ("source", "target"))
    return r.join(a, ["source_id", "source"]).join(b, ["source_id", "target"]).join(gone, "source_id").select("ordinal", F.col("source_i").alias("source"), F.col("target_i").alias("target"), "dropped")
