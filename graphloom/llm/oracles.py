"""SQL of those operators that SQL can express."""

from __future__ import annotations

from graphloom.llm import secrets

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = rf"""
WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS} AS words FROM documents),
  win AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(words[i:i + 19], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w)),
  later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
  gone AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM later) GROUP BY doc_id),
  kept AS (SELECT w.doc_id, len(words) AS n, coalesce(len(gone), 0) AS g, CASE WHEN gone IS NULL THEN array_to_string(words, ' ') ELSE (SELECT coalesce(string_agg(words[p], ' ' ORDER BY p), '') FROM (SELECT unnest(range(1, len(words) + 1)) AS p) WHERE NOT list_contains(gone, p)) END AS k FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(g AS BIGINT) AS n_removed, sha256(k) AS kept_sha256 FROM kept"""

LINE_DEDUP = r"""
WITH l AS MATERIALIZED (SELECT doc_id, n - 1 AS n, regexp_extract_all(lines[n], '[^\x20\x09-\x0D]+') AS w FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
  d AS MATERIALIZED (SELECT array_to_string(w, ' ') AS s, any_value(w) AS w, min((doc_id, n)) AS first FROM l WHERE len(w) >= 3 GROUP BY 1),
  v AS MATERIALIZED (SELECT s, first, i, md5(array_to_string(w[1:i - 1] || w[i + 1:], ' ')) AS h FROM (SELECT s, w, first, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) >= 5)),
  u AS (SELECT s, first, md5(s) AS h FROM d WHERE len(w) >= 5),
  near AS (SELECT s FROM (SELECT s, first, min(first) OVER (PARTITION BY h, i) AS low FROM v) WHERE low < first
    UNION SELECT v.s FROM v JOIN u ON v.h = u.h WHERE u.first < v.first UNION SELECT u.s FROM v JOIN u ON v.h = u.h WHERE v.first < u.first),
  gone AS (SELECT l.doc_id, count(*) AS c, string_agg(l.n, ',' ORDER BY l.n) AS removed FROM l JOIN d ON d.s = array_to_string(l.w, ' ') WHERE len(l.w) >= 3 AND ((l.doc_id, l.n) <> d.first OR d.s IN (SELECT s FROM near)) GROUP BY 1)
SELECT t.doc_id, CAST(len(string_split(coalesce(t.text, ''), chr(10))) AS BIGINT) AS n_lines, coalesce(c, 0) AS n_removed, coalesce(removed, '') AS removed FROM documents t LEFT JOIN gone ON gone.doc_id = t.doc_id"""


def _found(kind: int, pattern: str, keep: str = "true", group: int = 0) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, CAST(list_sum(list_transform(pieces[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS s, {kind} AS kind, length(hits[k]) AS n FROM
      (SELECT doc_id, pieces, hits, kept, unnest(range(1, len(hits) + 1)) AS k FROM (SELECT doc_id, string_split_regex(text, '{p}') AS pieces, regexp_extract_all(text, '{p}') AS hits, regexp_extract_all(text, '{p}', {group}) AS kept FROM t)) WHERE {keep}"""


_NAMES = "[" + ", ".join(f"'{k}'" for k in secrets.KINDS) + "]"
_OPAQUE = "regexp_matches(hits[k], '[0-9]') AND regexp_matches(hits[k], '[A-Z]') AND regexp_matches(hits[k], '[a-z]')"
_ADDRESS = f"""regexp_matches(hits[k], '{secrets.ADDRESS.replace(chr(39), chr(39) * 2)}')"""
_CLEAR = "NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = x.doc_id AND b.s < x.s + x.n AND x.s < b.s + b.n)"

SECRETS = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  base AS MATERIALIZED ({_found(0, secrets.ASSIGN, "length(kept[k]) >= 12", 2)} UNION ALL {_found(1, secrets.ACCESS, "length(hits[k]) >= 18")} UNION ALL {_found(2, secrets.HEX)}),
  weak AS MATERIALIZED (SELECT * FROM ({_found(3, secrets.IDENTIFIER)} UNION ALL {_found(4, secrets.OPAQUE, _OPAQUE)} UNION ALL {_found(5, secrets.ENDPOINT, _ADDRESS)}) x WHERE {_CLEAR}),
  parts AS (SELECT *, kind IN (0, 2, 4) AS secret FROM (SELECT * FROM base UNION ALL SELECT * FROM weak)),
  linked AS (SELECT * FROM weak w WHERE EXISTS (SELECT 1 FROM parts q WHERE q.doc_id = w.doc_id AND q.secret <> (w.kind = 4) AND q.s <= w.s + w.n + {secrets.SCOPE} AND q.s + q.n >= w.s - {secrets.SCOPE})),
  named AS (SELECT doc_id, s, kind, s + n AS e, {_NAMES}[kind + 1] || ':' || s || ':' || (s + n) AS span, b FROM (SELECT *, true AS b FROM base UNION ALL SELECT *, false FROM linked)),
  per AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS a, count(*) FILTER (WHERE kind = 1) AS c, count(*) FILTER (WHERE kind = 2) AS h, count(*) FILTER (WHERE NOT b) AS l, string_agg(span, ',' ORDER BY s, kind, e) FILTER (WHERE b) AS base, string_agg(span, ',' ORDER BY s, kind, e) AS every FROM named GROUP BY doc_id)
SELECT t.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(l, 0) AS n_linked, coalesce(every, '') AS spans FROM t LEFT JOIN per USING (doc_id)"""

EXACT_DEDUP = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS s FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(s) AS text_sha256 FROM t WINDOW w AS (PARTITION BY s)"""


def _crc32(value: str) -> str:
    """Unsigned CRC-32 of a string's UTF-8 bytes; ``crc.t`` is the table of the 256 bytes' remainders."""
    return f"""xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 2 * strlen({value}), 2), lambda k: CAST('0x' || substr(hex({value}), k, 2) AS BIGINT))), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])))"""


_CRC = """crc AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"""


def _field(name: str) -> str:
    return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || {name}, '-')"


_LEAF = "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars"))) + " || {text})"
_PARENTS = "list_transform(range(1, len(l) + 1, 3), lambda k: sha256(array_to_string(l[k:k + 2], '')))"


def _levels(name: str, leaves: str) -> str:
    """Each tree's levels as lists of digests."""
    return f"{name}(source, level, l) AS ({leaves} UNION ALL SELECT source, level + 1, {_PARENTS} FROM {name} WHERE len(l) > 1)"


def _siblings(tree: str, place: str) -> str:
    """(left, right) siblings, level by level, of the leaf at ``place`` from 0."""
    j = f"({place} // CAST(pow(3, level) AS BIGINT))"
    return f"struct_pack(lft := array_to_string({tree}.l[{j} - {j} % 3 + 1:{j}], ''), rgt := array_to_string({tree}.l[{j} + 2:{j} - {j} % 3 + 3], ''))"


MERKLE = f"""
WITH RECURSIVE {_CRC},
  d AS MATERIALIZED (SELECT doc_id, source, {_LEAF.format(text=_field("text"))} AS leaf, CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 AND contains(text, chr(10)) THEN {_LEAF.format(text=_field("replace(text, chr(10), '')"))} END AS tampered FROM documents, crc),
  {_levels("tree", "SELECT source, 0, list(leaf ORDER BY doc_id) FROM d GROUP BY source")},
  sub AS MATERIALIZED (SELECT source, l[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM tree WHERE len(l) = 1),
  {_levels("top", "SELECT 0, 0, list(subroot ORDER BY g) FROM sub")},
  i AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM d),
  steps AS (SELECT i.doc_id, level, {_siblings("tree", "i")} AS s FROM i JOIN tree ON tree.source IS NOT DISTINCT FROM i.source AND len(tree.l) > 1
    UNION ALL SELECT i.doc_id, 1000 + level, {_siblings("top", "g")} FROM i JOIN sub ON sub.source IS NOT DISTINCT FROM i.source JOIN top ON len(top.l) > 1),
  proof AS (SELECT doc_id, list(s.lft || ':' || s.rgt ORDER BY level) AS p FROM steps GROUP BY doc_id),
  f AS (SELECT d.doc_id, leaf, subroot, (SELECT l[1] FROM top WHERE len(l) = 1) AS root, sha256(replace(array_to_string(coalesce(p, []), ''), ':', '')) AS proof_sha256,
    list_reduce(list_prepend(coalesce(tampered, leaf), coalesce(p, [])), lambda h, s: sha256(split_part(s, ':', 1) || h || split_part(s, ':', 2))) AS folded_root
    FROM d JOIN sub ON sub.source IS NOT DISTINCT FROM d.source LEFT JOIN proof USING (doc_id))
SELECT *, folded_root = root AS verified FROM f"""

_RUN = r"[A-Za-z\x{C0}-\x{FF}]"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

VARIANTS = f"""
WITH RECURSIVE {_CRC},
  runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '{_RUN}{{7,}}')), '{_UPPER}', '{_UPPER.lower()}') AS run FROM documents),
  times AS MATERIALIZED (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
  hashed AS (SELECT run, n, {_crc32("(doc_id || ':' || run)")} AS h FROM times, crc),
  w AS MATERIALIZED (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2),
  v AS MATERIALIZED (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS v FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM w)),
  near AS MATERIALIZED (SELECT DISTINCT x.word AS a, y.word AS b, y.n FROM v x JOIN v y ON x.v = y.v AND x.k = y.k AND x.word <> y.word
    UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.v = w.word UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.v = w.word),
  best AS (SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, b) AS b, max(n) AS n FROM near GROUP BY a),
  formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 10 * w.n THEN b END AS form, CASE WHEN best.n >= 10 * w.n THEN best.n END AS form_n FROM w LEFT JOIN best ON a = word),
  chain(word, tip, depth) AS (SELECT word, word, 0 FROM w UNION ALL SELECT c.word, f.form, depth + 1 FROM chain c JOIN formed f ON f.word = c.tip WHERE f.form IS NOT NULL),
  ends AS (SELECT word, arg_max(tip, depth) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)"""
