"""The registered query of each operator, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from llm.decontaminate import op1_benchmark_decontamination
from llm.draw import op11_importance_draw
from llm.importance import op9_quality_classifier
from llm.licenses import op7_license_scan
from llm.mixing import op8_lm_scoring
from llm.phrases import op13_phrase_collocations
from llm.pieces import op10_sentencepiece
from llm.quality_rules import op4_quality_rules
from llm.repeats import op3_suffix_array_dedup
from llm.shards import op12_sharding
from llm.superminhash import op6_minhash_near_dedup
from llm.surrogates import op5_pii_surrogates
from llm.toxicity import op2_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_toxicity": op2_toxicity,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_pii_surrogates": op5_pii_surrogates,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_importance_draw": op11_importance_draw,
    "op12_sharding": op12_sharding,
    "op13_phrase_collocations": op13_phrase_collocations,
}



def _crc_table() -> str:
    """The CRC-32 of each byte, from its polynomial."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (c & 1) * 0xEDB88320
        out.append(c)
    return str(out)


def _crc(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text's UTF-8 bytes."""
    digit = "(instr('123456789ABCDEF', {}))"
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda o: CAST(16 * {digit.format('o[1]')} + {digit.format('o[2]')} AS UBIGINT))"
    step = f"xor(reg >> 8, CAST({_crc_table()}[CAST(xor(reg, o) & 255 AS INT) + 1] AS UBIGINT))"
    return f"CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), {octets}), lambda reg, o: {step}), CAST(4294967295 AS UBIGINT)) AS BIGINT)"


_LOWER = "translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The others rest on hashes, fitted models, keyed digests or token tables; tests hold them against plain versions.
SQL: dict[str, str] = {
    "op3_suffix_array_dedup": """
WITH d AS (SELECT doc_id, hex(encode(COALESCE(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, h, UNNEST(generate_series(0, length(h) // 2 - 100)) AS i FROM d) q),
f AS (SELECT doc_id, i, ROW_NUMBER() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS later FROM w),
g AS (SELECT doc_id, i, CASE WHEN i > COALESCE(LAG(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) + 100 THEN 1 ELSE 0 END AS new FROM f WHERE later),
s AS (SELECT doc_id, run, MIN(i) AS a, MAX(i) + 100 AS b FROM (SELECT *, SUM(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) q GROUP BY 1, 2),
p AS (SELECT s.*, COALESCE(LAG(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
k AS (SELECT p.doc_id, SUM(b - a) AS removed, COUNT(*) AS spans, MAX(b) AS last, STRING_AGG(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM p JOIN d ON d.doc_id = p.doc_id GROUP BY 1)
SELECT d.doc_id, length(h) // 2 AS n_bytes, CAST(COALESCE(removed, 0) AS BIGINT) AS n_removed, COALESCE(spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN k.doc_id IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op6_minhash_near_dedup": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, UNNEST(generate_series(1, CASE WHEN len(w) >= 5 THEN len(w) - 4 ELSE LEAST(len(w), 1) END)) AS i FROM d),
s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) >= 5 THEN w[i:i + 4] ELSE w END, ' ') AS sh FROM i),
n AS (SELECT d.doc_id, COUNT(s.sh) AS n FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS seen FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.seen)
SELECT n.doc_id, n.n AS n_shingles, MIN(r.seen) AS component_id, MIN(r.seen) = n.doc_id AS kept FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY 1, 2""",
    "op11_importance_draw": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT UNNEST(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
u AS (SELECT doc_id, UNNEST(w) AS w FROM d),
h AS (SELECT w, {_crc("w")} % 10000 AS bucket FROM (SELECT w FROM u UNION SELECT w FROM b) q),
s AS (SELECT bucket, COUNT(*) AS s FROM u JOIN h ON h.w = u.w GROUP BY 1),
t AS (SELECT bucket, COUNT(*) AS t FROM b JOIN h ON h.w = b.w GROUP BY 1),
g AS (SELECT s.bucket, CAST(FLOOR(1000 * ln((COALESCE(t, 0) + CAST(1 AS DOUBLE)) * ((SELECT COUNT(*) FROM u) + CAST(10000 AS DOUBLE)) / ((s + CAST(1 AS DOUBLE)) * ((SELECT COUNT(*) FROM b) + CAST(10000 AS DOUBLE))))) AS BIGINT) AS gain
  FROM s LEFT JOIN t ON t.bucket = s.bucket),
f AS (SELECT u.doc_id, COUNT(*) AS n, SUM(gain) AS total FROM u JOIN h ON h.w = u.w JOIN g ON g.bucket = h.bucket GROUP BY 1),
w AS (SELECT d.doc_id, COALESCE(n, 0) AS n_features, CASE WHEN n > 0 THEN CAST(total // n - CASE WHEN total % n < 0 THEN 1 ELSE 0 END AS BIGINT) ELSE 0 END AS weight,
  CAST('0x' || substr(sha256('2024:' || CAST(d.doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN f ON f.doc_id = d.doc_id),
x AS (SELECT doc_id, n_features, weight, weight + CAST(FLOOR(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score, n_features >= 20 AS can FROM w),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY can ORDER BY score DESC, doc_id) AS place FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN can AND place <= (SELECT COUNT(*) FROM x WHERE can) * 10 // 100 THEN place END AS rank FROM r""",
    "op12_sharding": f"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS text FROM documents),
x AS (SELECT doc_id, i, -ln((CAST(CAST('0x' || substr(md5('rendezvous:' || CAST(doc_id AS VARCHAR) || ':' || CAST(i AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0) AS draw
  FROM d CROSS JOIN (SELECT UNNEST(range(17)) AS i) s),
a AS (SELECT doc_id, arg_min(i, draw) FILTER (i < 16) AS shard, MIN(draw) FILTER (i < 16) AS draw, arg_min(i, draw) AS grown FROM x GROUP BY 1)
SELECT d.doc_id, CAST(strlen(text) + 1 AS BIGINT) AS size, {_crc("text")} AS text_crc32, 'key' AS law, CAST(shard AS INT) AS shard,
  ROW_NUMBER() OVER (PARTITION BY shard ORDER BY draw, d.doc_id) - 1 AS slot, CAST(grown AS INT) AS grown_shard FROM d JOIN a ON a.doc_id = d.doc_id""",
    "op13_phrase_collocations": rf"""
WITH p AS (SELECT doc_id, COALESCE(lang, 'und') AS lang, UNNEST(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, size, UNNEST(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM w CROSS JOIN (SELECT UNNEST(range(1, 5)) AS size) k WHERE len(w) >= size),
n AS (SELECT lang, COUNT(*) AS n FROM g WHERE size = 1 GROUP BY 1),
f AS (SELECT lang, size, phrase, COUNT(*) AS f, string_split(phrase, ' ') AS w FROM g GROUP BY 1, 2, 3 HAVING COUNT(*) >= 30),
c AS (SELECT lang, size, phrase, f AS a, w, UNNEST(range(1, size)) AS k FROM f WHERE size > 1),
s AS (SELECT c.lang, c.phrase, c.size, c.a, c.k, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM s),
z AS (SELECT lang, f, UNNEST(list_concat(CASE WHEN size >= 3 THEN [array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')] ELSE [] END,
  CASE WHEN size = 4 THEN [array_to_string(w[3:4], ' '), array_to_string(w[1:3], ' '), array_to_string(w[2:4], ' ')] ELSE [] END)) AS phrase FROM f),
v AS (SELECT lang, phrase, MAX(f) AS cover FROM z GROUP BY 1, 2),
o AS (SELECT b.lang, b.phrase, a, l, r, score, ROW_NUMBER() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN v ON v.lang = b.lang AND v.phrase = b.phrase WHERE cut = 1 AND (cover IS NULL OR CAST(100 AS HUGEINT) * cover < CAST(80 AS HUGEINT) * a))
SELECT o.lang, rank, o.phrase, a, l, r, n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000""",
}
