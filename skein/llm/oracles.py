"""DuckDB SQL of the corpus queries that SQL can express; the others are tested against brute force.

The SQL takes no shortcut: it joins all windows, all shingles and all positions of whole tables.
"""

from __future__ import annotations

from skein.llm.decontamination import WINDOW
from skein.llm.fim import RATE, SEED, SPM_RATE
from skein.llm.secrets import BASE, RULES, Rule
from skein.llm.sharding import SHARDS
from skein.llm.spelling import LEAST_COUNT, LEAST_LENGTH, MODULUS, RATIO

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(column: str, word: str) -> str:
    return f"regexp_extract_all({_LOWER.format(f"coalesce({column}, '')")}, '{word}')"


_ALPHANUMERIC = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_words('text', _ALPHANUMERIC)} AS w FROM documents),
i AS (SELECT item_id, {_words('text', _ALPHANUMERIC)} AS w FROM benchmark),
ip AS (SELECT item_id, w, least({WINDOW}, len(w)) AS size, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS p FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, size, array_to_string(w[p:p + size - 1], ' ') AS win FROM ip),
dp AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
dw AS (SELECT doc_id, p, size, array_to_string(w[p:p + size - 1], ' ') AS win FROM dp, (SELECT DISTINCT size FROM iw) WHERE p + size - 1 <= len(w)),
hits AS (SELECT doc_id, p, dw.size, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.size = iw.size),
covered AS (SELECT DISTINCT doc_id, unnest(range(p, p + size)) AS at FROM hits),
n AS (SELECT doc_id, count(*) AS n_hit FROM covered GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN ids USING (doc_id)"""


def _spans(rank: int, rule: Rule) -> str:
    """Rows (doc_id, start, rank, kind, fin) of one rule."""
    regex = rule.regex.replace("'", "''")
    # SQL's engine folds case beyond ASCII, so letters are spelt out
    for word in ("password|passwd|secret|token|api_?key",):
        regex = regex.replace(f"(?i:({word}))", "(" + "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) + ")")
    valid = f"regexp_extract_all(t, '{regex}', {rule.group})" if rule.group else "m"
    return (
        f"SELECT doc_id, CAST(list_sum(list_transform(g[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:j - 1], lambda x: length(x))), 0) AS BIGINT) AS start, {rank} AS rank, '{rule.kind}' AS kind, length(m[j]) AS size, length(v[j]) AS valid, {rule.least} AS least"
        f" FROM (SELECT doc_id, g, m, v, unnest(range(1, len(m) + 1)) AS j FROM (SELECT doc_id, string_split_regex(t, '{regex}') AS g, m, {valid} AS v FROM (SELECT doc_id, t, regexp_extract_all(t, '{regex}') AS m FROM d)))"
    )


_LISTED = "string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, rank)"
_BASE_KINDS = ", ".join(f"'{r.kind}'" for r in BASE)

SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(_spans(i, r) for i, r in enumerate(RULES))}),
f AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)}, {_LISTED} FILTER (kind IN ({_BASE_KINDS})) AS base, {_LISTED} AS spans FROM s WHERE valid >= least GROUP BY 1)
SELECT doc_id, {', '.join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN f USING (doc_id)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words('text', r"[^\x20\x09-\x0D]+")} AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM d),
k AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, sha256(array_to_string(s, chr(10))) AS c, s FROM s),
c AS (SELECT c, min(doc_id) AS rep, any_value(n) AS n, any_value(s) AS s FROM k WHERE n > 0 GROUP BY 1),
e AS (SELECT rep, n, unnest(s) AS x FROM c),
p AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS both_n FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * both_n >= 80 * (na + nb - both_n)),
links AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT rep AS a, rep AS b FROM c UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT a, min(b) AS least FROM reach GROUP BY 1)
SELECT k.doc_id, k.n AS n_shingles, coalesce(comp.least, k.doc_id) AS component_id, coalesce(comp.least, k.doc_id) = k.doc_id AS kept
FROM k LEFT JOIN c ON k.c = c.c AND k.n > 0 LEFT JOIN comp ON c.rep = comp.a"""



def _crc_step(n: int) -> int:
    """What four bits of a message add to its reflected CRC-32, whose polynomial is 0xEDB88320."""
    for _ in range(4):
        n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
    return n


_NIBBLES = r"list_transform(string_split(regexp_replace(hex(encode(text)), '(.)(.)', '\2\1', 'g'), ''), lambda x: strpos('0123456789ABCDEF', x) - 1)"
_CRC = f"xor(list_reduce(list_prepend(4294967295, {_NIBBLES}), lambda c, x: xor(c >> 4, {[_crc_step(n) for n in range(16)]}[(xor(c, x) & 15) + 1])), 4294967295)"

SHARDING = f"""
WITH d AS (SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) + 1 AS BIGINT) AS size, CASE WHEN text = '' THEN 0 ELSE CAST({_CRC} AS BIGINT) END AS text_crc32 FROM documents),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32 NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS start_byte, sum(size) OVER () AS total FROM d),
s AS (SELECT *, CAST(start_byte * {SHARDS} // total AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY start_byte) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s"""

_PIECE = "array_to_string(l[{0}:{1}], '')"
_FIM_OUT = f"CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END"


def _between(first: str, second: str | None) -> str:
    """What of output o stands after one mark and before another, or up to the end."""
    begin = f"strpos(o, '{first}') + 3"
    return f"substr(o, {begin}, strpos(o, '{second}') - ({begin}))" if second else f"substr(o, {begin})"


FIM = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS l, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, t, l, len(l) AS n, {', '.join(f"CAST('0x' || substr(x, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))} FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS c1, greatest(h1 % (n + 1), h2 % (n + 1)) AS c2,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM h),
q AS (SELECT *, {_PIECE.format('1', 'c1')} AS p, {_PIECE.format('c1 + 1', 'c2')} AS m, {_PIECE.format('c2 + 1', 'n')} AS s FROM c),
o AS (SELECT *, {_FIM_OUT} AS o FROM q),
r AS (SELECT *, CASE form WHEN 'plain' THEN o WHEN 'psm' THEN {_between('<P>', '<S>')} || {_between('<M>', None)} || {_between('<S>', '<M>')} ELSE {_between('<P>', '<M>')} || {_between('<M>', None)} || {_between('<S>', '<P>')} END AS back FROM o)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(o) AS output_sha256, sha256(back) AS restored_sha256 FROM r"""

# near words share what a deleted letter leaves: at the same place if a letter is replaced, or one word is what it leaves of the other
_RUN_CRC = _CRC.replace("encode(text)", "encode(k)")
SPELLING = f"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS r FROM documents),
g AS (SELECT doc_id, {_LOWER.format('r')} AS w, count(*) AS n FROM r WHERE length(r) >= {LEAST_LENGTH} GROUP BY 1, 2),
k AS (SELECT w, n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS k FROM g),
h AS (SELECT w, n, CAST({_RUN_CRC} AS BIGINT) AS h FROM k),
o AS (SELECT CASE WHEN h % {MODULUS} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM o WHERE length(word) >= {LEAST_LENGTH} GROUP BY 1 HAVING sum(n) >= {LEAST_COUNT}),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
v AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM p),
e AS (SELECT a.word AS a, b.word AS b, b.n AS m FROM v a JOIN v b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.v = w.word UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.v = w.word),
b AS (SELECT a AS word, count(*) AS n_near, max(m) AS m, arg_min(b, ROW(-m, b)) AS best FROM e GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {RATIO} * w.n THEN best END AS form, CASE WHEN m >= {RATIO} * w.n THEN m END AS form_n FROM w LEFT JOIN b USING (word)),
s AS (SELECT word, word AS at, form AS nxt FROM f UNION ALL SELECT s.word, f.word, f.form FROM s JOIN f ON s.nxt = f.word)
SELECT f.word, f.form, s.at AS root, f.n, f.n_near, f.form_n FROM f JOIN s ON s.word = f.word AND s.nxt IS NULL"""

ORACLES = {"op11_fim": FIM, "op13_spelling": SPELLING, "op1_sharding": SHARDING, "op2_decontamination": CONTAMINATION, "op3_secrets": SECRETS, "op6_minhash": NEAR_DUPLICATES}
