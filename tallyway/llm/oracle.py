"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

GAP = r"[\x20\x09-\x0D]"
_SPLIT = "string_split_regex(t, '{p}')"
_ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = (("assign", _ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]{16,}", 0, 0), ("hex", "[0-9a-f]{24,}", 0, 0), ("owned", "[A-Za-z0-9+/_-]{20,}", 0, 0))


def _located(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Spans of one pattern: matches and what lies between them, with running lengths."""
    return f"""SELECT doc_id, rid, source, {rank} AS rank, '{kind}' AS kind, s AS start, s+len(h) AS stop, v AS value FROM (
      SELECT doc_id, rid, source, unnest(hits) AS h, unnest(vals) AS v, unnest(list_transform(range(len(hits)), lambda i: CAST(list_sum(list_transform(range(i+1), lambda j: len(gaps[j+1])+CASE WHEN j<i THEN len(hits[j+1]) ELSE 0 END)) AS BIGINT))) AS s FROM (
        SELECT doc_id, rid, source, regexp_extract_all(t,'{pattern}') AS hits, regexp_extract_all(t,'{pattern}',{group}) AS vals, string_split_regex(t,'{pattern}') AS gaps FROM d WHERE regexp_matches(t,'{pattern}'))) WHERE len(v)>={least}"""


OP5 = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS rid, source, coalesce(text,'') AS t FROM documents),
base AS ({' UNION ALL '.join(_located(i, *k) for i, k in enumerate(_KINDS[:3]))}),
wide AS (SELECT * FROM ({_located(3, *_KINDS[3])}) w WHERE len(regexp_replace(value,'[^0-9]+','','g'))>=4 AND len(regexp_replace(value,'[^A-Za-z]+','','g'))>=4 AND len(list_distinct(string_split(value,'')))>=10
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid=w.rid AND b.start<w.stop AND w.start<b.stop)),
held AS (SELECT DISTINCT value, coalesce(source,chr(1)) AS owner, doc_id FROM (SELECT value, source, doc_id FROM base UNION ALL SELECT value, source, doc_id FROM wide)),
owners AS (SELECT value, count(DISTINCT owner) AS n, count(*) AS repositories FROM held GROUP BY value),
live AS (SELECT w.* FROM wide w JOIN owners o ON o.value=w.value WHERE o.n<3 AND o.repositories<20),
b AS (SELECT rid, count(*) FILTER (WHERE rank=0) AS a, count(*) FILTER (WHERE rank=1) AS c, count(*) FILTER (WHERE rank=2) AS h, string_agg(kind||':'||start||':'||stop, ',' ORDER BY start, rank) AS s FROM base GROUP BY rid),
e AS (SELECT rid, string_agg(kind||':'||start||':'||stop, ',' ORDER BY start, rank) AS s, count(*) FILTER (WHERE rank=3) AS o FROM (SELECT rid, kind, rank, start, stop FROM base UNION ALL SELECT rid, kind, rank, start, stop FROM live) GROUP BY rid)
SELECT doc_id, coalesce(a,0) AS n_assign, coalesce(c,0) AS n_access, coalesce(h,0) AS n_hex, sha256(coalesce(b.s,'')) AS base_sha256, coalesce(e.s,'') AS spans, coalesce(o,0) AS n_owned
FROM d LEFT JOIN b ON b.rid=d.rid LEFT JOIN e ON e.rid=d.rid"""

_FIVE = ", ".join(f"CAST('0x'||substr(h,{5 * k + 1},5) AS BIGINT)" for k in range(8))
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
OP8 = f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html,''))) AS payload_bytes, sha1(coalesce(html,'')) AS h FROM pages), m AS (SELECT h AS g, max(page_id) AS top FROM p GROUP BY h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, array_to_string(flatten(list_transform([{_FIVE}], lambda x: list_transform([15,10,5,0], lambda b: substr('{_LETTERS}', CAST((x >> b) & 31 AS INT)+1, 1)))),'') AS payload_digest,
CASE WHEN page_id IS DISTINCT FROM top AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to FROM p JOIN m ON h=g"""

#: All pairs that share a shingle, then the closure of the similar ones; for small tables only.
OP9 = rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text,''),'{GAP}+'), lambda x: x<>'') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(len(ws)-4), lambda i: array_to_string(ws[i+1:i+5],' '))) AS g FROM w WHERE len(ws)>=5),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g=b.g AND a.doc_id<b.doc_id GROUP BY 1,2),
near AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id=a JOIN n y ON y.doc_id=b WHERE k>=0.8*(x.n+y.n-k) UNION SELECT x.doc_id, y.doc_id FROM w x JOIN w y ON x.ws=y.ws AND x.doc_id<y.doc_id WHERE len(x.ws)>0),
link AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b=l.a)
SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a"""

#: The checksum by its table; near words meet with one letter left open, or where one less a letter is the other.
OP13 = """WITH RECURSIVE steps AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
each AS (SELECT d, w, count(*) AS k, flatten(list_transform(string_split(d || ':' || w, ''), lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [CAST(192 + (ord(c) >> 6) AS BIGINT), CAST(128 + (ord(c) & 63) AS BIGINT)] END)) AS b FROM runs GROUP BY d, w),
summed AS (SELECT w, k, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM each, steps),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM summed) WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
spots AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
opened AS (SELECT word, n, substr(word, 1, i) || '*' || substr(word, i + 2) AS g FROM spots),
shorter AS (SELECT DISTINCT word, n, substr(word, 1, i) || substr(word, i + 2) AS g FROM spots),
less AS (SELECT s.word AS a, s.n AS an, w.word AS b, w.n AS bn FROM shorter s JOIN words w ON w.word = s.g),
near AS (SELECT x.word, x.n, y.word AS other, y.n AS other_n FROM opened x JOIN opened y ON x.g = y.g AND x.word <> y.word UNION SELECT a, an, b, bn FROM less UNION SELECT b, bn, a, an FROM less),
best AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS r FROM near),
forms AS (SELECT word, n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n FROM best WHERE r = 1),
chain AS (SELECT word, form AS root FROM forms WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c LEFT JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
SELECT w.word, f.form, coalesce(e.root, w.word) AS root, w.n, coalesce(f.n_near, 0) AS n_near, f.form_n FROM words w LEFT JOIN forms f ON f.word = w.word LEFT JOIN ends e ON e.word = w.word"""

SQL = {"op5_secret_scan": OP5, "op8_warc": OP8, "op9_dart_minhash": OP9, "op13_spelling": OP13}
