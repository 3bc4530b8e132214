"""The corpus operators' queries, opN_<name>, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import chat_tree, decontaminate, exact_dedup, html_text, lexical, mixing, quality, secrets, simhash, spelling, token_files, toxicity
from waymark.llm.common import table
from waymark.llm.token_counts import count_tokens


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer())


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), 0.5)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")), 0.3)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op8_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_tree.digest(chat_tree.read_back(chat_tree.build(rows, tokenizer())))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_documents(token_files.write(table(spark, sf_dir, "documents"), tokenizer()))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    return lexical.search(lexical.build_index(table(spark, sf_dir, "documents"), items), items)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.word_counts(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_secret_scan, op3_exact_dedup, op4_html_extraction, op5_toxicity, op6_quality, op7_simhash, op8_chat_tree, op9_decontamination, op10_mixing, op11_token_files, op12_lexical_search, op13_spelling_variants)}


OP3_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""

#: The formatted length of a turn: the template's 15 characters, role, text, and a backslash for each escaped character.
OP8_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), t AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM said
),
e AS (
  SELECT *, length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7
         + CASE WHEN contains(text, '###') THEN len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 3) = '###')) ELSE 0 END
         + length(role) - length(replace(replace(role, '\', ''), ':', '')) AS escapes
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(15 + length(role) + length(text) + escapes)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id, lone
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, len(x) AS size, array_to_string(x, ' ') AS w
  FROM (SELECT item_id, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda i: ws[i : least(i + 9, len(ws))])) AS x FROM b WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT size FROM iw),
dw AS (
  SELECT doc_id, size, unnest(range(1, len(ws) - size + 2)) AS pos, ws FROM d, sizes WHERE len(ws) >= size
), hit AS (
  SELECT DISTINCT dw.doc_id, dw.pos, dw.size, iw.item_id FROM dw JOIN iw ON iw.size = dw.size AND iw.w = array_to_string(dw.ws[dw.pos : dw.pos + dw.size - 1], ' ')
), words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS p FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

#: Shares: a source's target is the smaller of its cap and level x weight; the level is where all targets add up (the highest of the levels with the first sources capped). Documents go
#: in by their draw: a source's base copies, then in the order of draws as far as the rest of its target reaches.
OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS draw FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source
), c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER up, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER up, 0)) AS level
  FROM c WINDOW up AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM l
), n AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS base FROM t
), r AS (
  SELECT d.doc_id, d.size, n.source_size, n.target, n.base, n.target - n.base * n.source_size AS need,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw) AS after, sum(d.size) OVER (PARTITION BY d.source, d.draw) AS own
  FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source
)
SELECT doc_id, size, source_size, target,
       (size * (base + CASE WHEN after <= need OR (after - own <= need AND after - need <= need - (after - own)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""


#: Scores as sums of whole numbers; ranks by score, then id.
OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
), q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), a AS (SELECT count(*)::BIGINT AS nd, sum(len(ws))::BIGINT AS total FROM d WHERE len(ws) > 0),
p AS (SELECT doc_id, r, len(ws)::BIGINT AS n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, r, ws, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, r, ws, term),
f AS (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term),
v AS (
  SELECT p.doc_id, p.r, p.term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // total))) AS value
  FROM p JOIN f USING (term), a
), s AS (SELECT item_id, doc_id, r, sum(value)::BIGINT AS score FROM q JOIN v USING (term) GROUP BY item_id, doc_id, r),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM k WHERE rank <= 20
"""


#: crc32 by its table, which a rule makes; near words share the rest after one code point is taken out at one place, or are that rest.
OP13_SQL = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS k, hex(encode(coalesce(doc_id::VARCHAR, 'None') || ':' || run)) AS hx FROM r GROUP BY doc_id, run),
h AS (SELECT run, k, xor(list_reduce(list_transform(range(1, length(hx), 2), lambda i: ('0x' || substr(hx, i, 2))::BIGINT), lambda s, b: xor(tab[(xor(s, b) & 255) + 1], s >> 8), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM g, t),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(k)::BIGINT AS n FROM h GROUP BY 1),
v AS (SELECT word, n FROM w WHERE length(word) >= 5 AND n >= 3),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word, b.word AS other, b.n AS m FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word UNION SELECT v.word, d.word, d.n FROM v JOIN d ON d.rest = v.word UNION SELECT d.word, v.word, v.n FROM v JOIN d ON d.rest = v.word),
b AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END::BIGINT AS form_n FROM v LEFT JOIN b USING (word)),
u(word, root) AS (SELECT word, form FROM f WHERE form IS NOT NULL UNION ALL SELECT u.word, f.form FROM u JOIN f ON f.word = u.root WHERE f.form IS NOT NULL),
l AS (SELECT u.word, u.root FROM u JOIN f ON f.word = u.root WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(l.root, f.word) AS root, f.n, f.n_near, f.form_n FROM f LEFT JOIN l USING (word)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op8_chat_tree": OP8_SQL, "op9_decontamination": OP9_SQL, "op10_mixing": OP10_SQL, "op12_lexical_search": OP12_SQL, "op13_spelling_variants": OP13_SQL}
