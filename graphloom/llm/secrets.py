"""Secret scans with multipart credential linking, in DataFrame functions alone.

Strong parts are reported wherever they stand. Weak parts, identifiers, opaque strings and endpoints
that mean nothing alone, are reported only if a part that complements them lies in the scope around them.
The link is an interval join inside documents: scopes are cut into cells of one scope's width,
so a part meets only what lies in its own and the neighbouring cells.

Patterns repeat single characters only, and none starts again inside a run that it has read: a text of any length
takes time in proportion to it and no depth of calls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import rows_of, text_key
from graphloom.plans.scratch import materialise

# The patterns, in the order of their kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # as [0-9a-f]+ of 16 or more: runs are maximal
IDENTIFIER = r"""(?i)(?:client|account|user|tenant|app|access|key)[_-]?(?:key[_-]?)?(?:id|name)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}"""
OPAQUE = r"[A-Za-z0-9+/_-]{24,}={0,2}"
ENDPOINT = r"""https?://[^\s"'<>]+|[A-Za-z0-9.-]+(?::[0-9]+)?"""
#: What an endpoint looks like: an address of four characters or more, or a dotted host with a port.
ADDRESS = r"""^(?:https?://.{4}|[A-Za-z0-9.-]*[A-Za-z0-9-]\.[A-Za-z0-9-][A-Za-z0-9.-]*:[0-9]{2,5}$)"""

KINDS = ("assign", "access", "hex", "identifier", "opaque", "endpoint")
#: Role of each kind: identifiers (0), secrets (1), endpoints (2).
ROLES = (1, 0, 1, 0, 1, 2)
#: Code points between two parts that can still belong together.
SCOPE = 400
#: Matches whose places are added up together.
_BLOCK = 128

_SPAN = "struct<start:int,kind:int,end:int>"
_NONE = f"array<{_SPAN}>"


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def _running(steps: Column, first: Column, step: Callable[[Column, Column], Column], put: Callable[[Column, Column], Column], kind: str) -> Column:
    """``put(place, step)`` of each step that it isn't null for, where places add up from ``first``."""
    folded = F.aggregate(
        steps,
        F.struct(first.cast("int").alias("at"), F.array().cast(f"array<{kind}>").alias("out")),
        lambda s, x: F.struct(
            step(s["at"], x).alias("at"),
            F.when(put(s["at"], x).isNotNull(), F.concat(s["out"], F.array(put(s["at"], x)))).otherwise(s["out"]).alias("out"),
        ),
    )
    return folded["out"]


def _found(text: Column, pattern: str, kind: int, keep=None, group: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches that ``keep`` holds for.

    Matches and the pieces between them come in the same order, so their lengths add up to places: first of whole blocks
    of matches, then inside each block, since a list that grows by one match at a time is copied each time.
    """
    size = lambda x: F.coalesce(x["size"], F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.zip_with(
        F.split(text, pattern, -1),
        F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), kept.alias("kept")) if group else F.transform(kept, lambda m: F.struct(m.alias("hit"), m.alias("kept"))),
        lambda gap, m: F.struct(
            F.length(gap).alias("gap"),
            F.length(m["hit"]).alias("size"),
            (F.coalesce(keep(m["kept"]), F.lit(False)) if keep else m["hit"].isNotNull()).alias("kept"),
        ),
    )
    after = lambda at, x: at + x["gap"] + size(x)
    span = lambda at, x: F.when(x["kept"], F.struct((at + x["gap"]).cast("int").alias("start"), F.lit(kind).alias("kind"), (at + x["gap"] + x["size"]).cast("int").alias("end")))

    def placed(steps: Column) -> Column:
        many = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _BLOCK).cast("int"))
        blocks = F.transform(many, lambda b: F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK)))
        return _with(
            F.transform(blocks, lambda block: F.struct(block.alias("steps"), F.aggregate(block, F.lit(0), lambda s, x: s + x["gap"] + size(x)).alias("total"))),
            lambda blocks: F.flatten(
                F.zip_with(
                    blocks,
                    _running(blocks, F.lit(0), lambda at, b: at + b["total"], lambda at, b: at, "int"),
                    lambda b, at: _running(b["steps"], at, after, span, _SPAN),
                )
            ),
        )

    return F.when(text.rlike(pattern), _with(steps, placed)).otherwise(F.array().cast(_NONE))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def _role(kind: Column) -> Column:
    return F.array(*[F.lit(r) for r in ROLES])[kind]


def _near(left: DataFrame, right: DataFrame, scope: int, reach: int, also: Column, how: str) -> DataFrame:
    """``left`` rows (doc_id, t, s) with (or without) a right one (doc_id, t, p) of the same text less than ``reach`` away."""
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / scope), F.floor(high / scope)))
    a = left.withColumn("cell", cells(F.col("s.start") - reach, F.col("s.end") + reach)).alias("a")
    b = right.withColumn("cell", cells(F.col("p.start"), F.col("p.end") - 1)).alias("b")
    met = (
        F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
        & (F.col("a.t") == F.col("b.t"))
        & (F.col("a.cell") == F.col("b.cell"))
        & (F.col("b.p.start") < F.col("a.s.end") + reach)
        & (F.col("b.p.end") > F.col("a.s.start") - reach)
        & also
    )
    return a.join(b, met, how).drop("cell")


def linked_parts(scanned: DataFrame, scope: int = SCOPE, held: Callable[[DataFrame, str], DataFrame] = lambda df, tag: df) -> DataFrame:
    """(doc_id, t, linked): the weak spans of ``scanned`` (doc_id, t, base, weak) with a complement in scope.

    Weak spans that overlap a base span are part of it and no candidates. An identifier or an endpoint wants a
    secret, a secret an identifier or an endpoint. ``held`` writes what is read more than once.
    """
    some = scanned.where(F.size("weak") > 0)
    weak = some.select("doc_id", "t", F.explode("weak").alias("s")).distinct()
    base = some.select("doc_id", "t", F.explode("base").alias("p")).distinct()
    inside = _near(weak, base, scope, 0, F.lit(True), "left_semi").distinct().alias("i")
    w = weak.alias("w")
    same = F.col("w.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("w.t") == F.col("i.t")) & (F.col("w.s") == F.col("i.s"))
    clear = held(w.join(inside, same, "left_anti"), "clear")
    complement = (_role(F.col("a.s.kind")) == 1) != (_role(F.col("b.p.kind")) == 1)
    parts = base.unionByName(clear.select("doc_id", "t", F.col("s").alias("p")))
    return _near(clear, parts, scope, scope + 1, complement, "left_semi").groupBy("doc_id", "t").agg(F.collect_set("s").alias("linked"))


def secret_scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, n_linked, spans) of each row of ``docs`` (doc_id, text).

    Spans are code points, end exclusive, written kind:start:end by start, kind and end. Null
    text is empty and has no spans: ``spans`` is then the empty string and ``base_sha256`` its hash. Rows that repeat a doc_id
    are scanned each. Spans of one document are one row at most, whatever its length.
    """
    text = F.col("text")
    base = F.array_sort(F.concat(
        _found(text, ASSIGN, 0, lambda g: F.length(g) >= 12, group=2),
        _found(text, ACCESS, 1, lambda m: F.length(m) >= 18),
        _found(text, HEX, 2),
    ))
    weak = F.concat(
        _found(text, IDENTIFIER, 3),
        _found(text, OPAQUE, 4, lambda m: m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")),
        F.when(text.rlike("https?://|[A-Za-z0-9-]:[0-9]{2}"), _found(text, ENDPOINT, 5, lambda m: m.rlike(ADDRESS))).otherwise(F.array().cast(_NONE)),
    )
    rows = rows_of(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    scanned = materialise(rows.select("doc_id", text_key("text").alias("t"), base.alias("base"), weak.alias("weak")), "secrets")
    b, m = scanned.alias("b"), linked_parts(scanned, scope, materialise).alias("m")
    every = b.join(m, F.col("b.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("b.t") == F.col("m.t")), "left").select(
        "b.doc_id", "b.base", F.coalesce("m.linked", F.array().cast(_NONE)).alias("linked")
    )
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return every.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        F.size("linked").cast("bigint").alias("n_linked"),
        _written(F.array_sort(F.concat("base", "linked"))).alias("spans"),
    )
