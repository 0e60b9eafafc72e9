"""Queries for operators that the main catalogue reaches only inside larger ones; registered with it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lucerna.functions import text as T
from lucerna.functions.jsontext import json_items
from lucerna.operators import crush, detect, diffs, kneedle, logs, outliers, relevance, search
from lucerna.plans.queries import _BM25, _DIFF, _FIELDS, _GREP, _LOGS, _NORMAL, _STACK, ORACLE_SQL, _event_fields, _replies, cache_tiers, diff_blocks, grep_blocks, json_blocks, load, log_blocks, query
from lucerna.sources import store
from lucerna.sources.messages import messages_of, normalize_system
from lucerna.streaming import cache

_TOKENS = r"regexp_extract_all(lower({}), '[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}|\b\d{{4,}}\b|[a-z0-9_]+')"

# --- sources, lines, scalars ----------------------------------------------------------------------------------------


@query("ref_op02_messages", "SELECT conv_id, turn, role, 1 AS n_parts, 'text' AS type, md5(text) AS text_md5 FROM conversations")
def messages(spark, sf_dir):
    part = F.get("parts", 0)
    return messages_of(load(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", F.size("parts").alias("n_parts"), part["type"].alias("type"), F.md5(part["text"]).alias("text_md5"))


@query("ref_op03_system_prompt", rf"""
WITH t AS (SELECT o_orderkey, unnest([0, 1]) AS i, unnest(['Today is ' || strftime(o_orderdate, '%Y-%m-%d') || ' here', 'Run ' || md5(CAST(o_orderkey AS VARCHAR)) || ' of ' || o_orderstatus]) AS text FROM orders)
SELECT o_orderkey, CAST(i AS INT) AS i, {_NORMAL} AS normalized FROM t""")
def system_prompt(spark, sf_dir):
    day = F.concat(F.lit("Today is "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" here"))
    run = F.concat(F.lit("Run "), F.md5(F.col("o_orderkey").cast("string")), F.lit(" of "), F.col("o_orderstatus"))
    return load(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(normalize_system(F.array(day, run))).alias("i", "normalized"))


@query("ref_op04_lines", "SELECT doc_id, CAST(unnest(range(len(l))) AS INT) AS idx, md5(unnest(l)) AS line_md5 FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)")
def line_scan(spark, sf_dir):
    return logs.explode_lines(load(spark, sf_dir, "documents"), "doc_id").select(F.col("block_id").alias("doc_id"), "idx", F.md5("content").alias("line_md5"))


@query("ref_op15_json_writer", r"""
SELECT o_custkey AS block_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS item_idx,
  '{' || chr(10) || '    "id": ' || o_orderkey || ',' || chr(10) || '    "status": "' || o_orderstatus || '",' || chr(10) || '    "priority": "' || o_orderpriority || '"' || chr(10) || '  }' AS pretty FROM orders""")
def json_writer(spark, sf_dir):
    items = json_blocks(spark, sf_dir).select("block_id", F.posexplode(json_items(F.col("text"))).alias("item_idx", "item"))
    return items.select("block_id", "item_idx", "item.pretty")


@query("ref_op20_retrieve_hint", f"SELECT doc_id, '{T.HINT}<<ccr:' || substr(sha256(text), 1, 24) || '>>' AS hint FROM documents")
def retrieve_hint(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.retrieve_hint(T.content_key(F.col("text"))).alias("hint"))


@query("ref_op24_ratio", "SELECT doc_id, round(length(substr(text, 1, 100)) / length(text), 6)::DOUBLE AS ratio FROM documents WHERE text <> ''")
def ratio(spark, sf_dir):
    d = load(spark, sf_dir, "documents").filter("text <> ''")
    return d.select("doc_id", F.round(T.compression_ratio(F.substring("text", 1, 100), F.col("text")), 6).alias("ratio"))


# --- detection ------------------------------------------------------------------------------------------------------

_CODE_LINE = (
    "def f{}(x):",
    "import m{}",
    "class C{} {{",
    "func run{}(a int) error {{",
    "pub fn g{}",
    "  return x{}",
    "const a{} = 1",
    "public class P{} {{",
)
_CODE_SQL = " ".join(f"WHEN {i} THEN '" + line.replace("{{", "{").replace("{}", "' || p_partkey || '") + "'" for i, line in enumerate(_CODE_LINE))
_CODE_HITS = ", ".join(f"('{name}', {i}, '" + pattern.replace(detect._S, r"\s").replace(detect.END, r"\b") + "')" for i, (name, pattern) in enumerate(detect.CODE_PATTERNS.items()))


@query("ref_op37_detect_code", f"""
WITH l AS (SELECT p_partkey // 40 AS block_id, p_partkey, CASE p_partkey // 40 * 3 % 5 + p_size % 4 {_CODE_SQL} END AS line FROM part),
h AS (SELECT block_id, name, o, count(*) AS n, min(pos) AS first FROM (SELECT block_id, line, row_number() OVER (PARTITION BY block_id ORDER BY p_partkey) AS pos FROM l), (VALUES {_CODE_HITS}) v(name, o, pat) WHERE regexp_matches(line, pat) GROUP BY ALL),
b AS (SELECT block_id, name, n FROM h QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY n DESC, first, o) = 1)
SELECT CAST(block_id AS BIGINT) AS block_id, name AS language, CAST(n AS INT) AS pattern_matches, round(least(1.0, 0.4 + 0.4 * n / (SELECT count(*) FROM l WHERE l.block_id = b.block_id) + 0.02 * n), 6)::DOUBLE AS confidence FROM b WHERE n >= 3""")
def detect_code(spark, sf_dir):
    p = load(spark, sf_dir, "part").withColumn("block_id", F.floor(F.col("p_partkey") / 40).cast("long"))
    parts = lambda line: line.replace("{{", "{").split("{}")
    made = [F.concat(F.lit(parts(line)[0]), F.col("p_partkey").cast("string"), F.lit(parts(line)[1])) for line in _CODE_LINE]
    line = F.element_at(F.array(*made), (F.col("block_id") * 3 % 5 + F.col("p_size") % 4 + 1).cast("int"))
    lines = p.groupBy("block_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", line.alias("line")))), lambda r: r["line"]).alias("lines"))
    found = lines.select("block_id", detect.code_of(F.col("lines")).alias("d")).filter("d is not null")
    return found.select("block_id", "d.language", "d.pattern_matches", F.round("d.confidence", 6).alias("confidence"))


# --- fields and items -----------------------------------------------------------------------------------------------


@query("ref_op39_field_presence", f"WITH {_FIELDS} SELECT block_id, key, n FROM k")
def field_presence(spark, sf_dir):
    return outliers.field_presence(_event_fields(spark, sf_dir)[0])


@query("ref_op42_status_fields", f"WITH {_FIELDS} SELECT block_id, key, count(*) AS total FROM f GROUP BY ALL HAVING count(DISTINCT value) BETWEEN 2 AND 50")
def status_fields(spark, sf_dir):
    return outliers.status_fields(_event_fields(spark, sf_dir)[0])


@query("ref_op81_rare_field_items", f"WITH {_FIELDS} SELECT f.block_id, f.item_idx FROM f JOIN k ON k.block_id = f.block_id AND k.key = f.key JOIN n ON n.block_id = f.block_id WHERE k.n < n.items * 0.2")
def rare_field_items(spark, sf_dir):
    fields, sizes = _event_fields(spark, sf_dir)
    return outliers.rare_field_items(fields, outliers.field_kinds(fields, sizes))


@query("ref_op82_rare_value_items", f"""
WITH {_FIELDS}, m AS (SELECT f.* FROM f JOIN k ON k.block_id = f.block_id AND k.key = f.key JOIN n ON n.block_id = f.block_id WHERE k.n >= n.items * 0.8),
u AS (SELECT block_id, key, value, count(*) AS n FROM m GROUP BY ALL),
v AS (SELECT *, sum(n) OVER (PARTITION BY block_id, key) AS total, count(*) OVER (PARTITION BY block_id, key) AS d FROM u),
r AS (SELECT *, sum(n) OVER (PARTITION BY block_id, key ORDER BY n DESC, value ROWS UNBOUNDED PRECEDING) - n AS before FROM v WHERE d BETWEEN 2 AND 50),
h AS (SELECT *, count(*) OVER (PARTITION BY block_id, key) AS size FROM r WHERE before < ceil(total * 0.8))
SELECT block_id, item_idx FROM m WHERE EXISTS (SELECT 1 FROM h WHERE h.size <= 5 AND h.block_id = m.block_id AND h.key = m.key) AND NOT EXISTS (SELECT 1 FROM h WHERE h.size <= 5 AND h.block_id = m.block_id AND h.key = m.key AND h.value = m.value)""")
def rare_value_items(spark, sf_dir):
    fields, sizes = _event_fields(spark, sf_dir)
    return outliers.rare_value_items(fields, outliers.field_kinds(fields, sizes))


@query("ref_op54_anchored_sample", """
WITH i AS (SELECT o_custkey AS block_id, o_orderkey AS item_idx, o_orderstatus || ' ' || o_orderpriority AS json, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY o_custkey) AS m FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
p AS (SELECT *, CASE WHEN pos < 2 THEN 0 WHEN pos >= m - 1 THEN 2 ELSE 1 END AS part FROM i),
q AS (SELECT *, row_number() OVER (PARTITION BY block_id, part ORDER BY item_idx) - 1 AS mid, count(*) OVER (PARTITION BY block_id, part) AS mids FROM p),
t AS (SELECT *, CASE WHEN part = 1 THEN mid ELSE pos END AS n FROM q WHERE part <> 1 OR mid % greatest(1, mids // 3) = 0 AND mid // greatest(1, mids // 3) < 3)
SELECT block_id, item_idx, json, CAST(part AS INT) AS part FROM t QUALIFY row_number() OVER (PARTITION BY block_id, json ORDER BY part, n) = 1""")
def anchored_sample(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("block_id"), F.col("o_orderkey").alias("item_idx"), F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("json"), F.lit(False).alias("outlier"), F.lit(6).alias("k"))
    return crush.choose_items(o).select("block_id", "item_idx", "json", "part")


# --- fingerprints ---------------------------------------------------------------------------------------------------


@query("ref_op46_clusters", """
WITH RECURSIVE d AS (SELECT doc_id % 50 AS g, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id) AS i, CAST(doc_id * 7 % 512 AS BIGINT) AS x FROM documents),
r(g, i, ls) AS (SELECT g, i, [x] FROM d WHERE i = 1 UNION ALL
  SELECT r.g, d.i, CASE WHEN len(list_filter(ls, lambda c: bit_count(xor(c, d.x)) <= 3)) > 0 THEN ls ELSE list_append(ls, d.x) END FROM r JOIN d ON d.g = r.g AND d.i = r.i + 1)
SELECT g, CAST(len(arg_max(ls, i)) AS INT) AS clusters FROM r GROUP BY g""")
def clusters(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("g"), F.struct("doc_id", (F.col("doc_id") * 7 % 512).cast("long").alias("x")).alias("p"))
    prints = d.groupBy("g").agg(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["x"]).alias("prints"))
    return prints.select("g", kneedle.cluster_count(F.col("prints")).alias("clusters"))


@query("ref_op86_hamming", "SELECT doc_id, CAST(bit_count(xor(CAST(doc_id * 7919 AS BIGINT), CAST(doc_id * 31 AS BIGINT))) AS INT) AS distance FROM documents")
def hamming(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", kneedle.hamming((F.col("doc_id") * 7919).cast("long"), (F.col("doc_id") * 31).cast("long")).alias("distance"))


# --- relevance ------------------------------------------------------------------------------------------------------


@query("ref_op43_term_frequency", f"SELECT conv_id, turn, term, CAST(count(*) AS INT) AS n FROM (SELECT conv_id, turn, unnest({_TOKENS.format('text')}) AS term FROM conversations) GROUP BY ALL")
def term_frequency(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.explode(relevance.term_frequency(relevance.tokens(F.col("text")))).alias("term", "n"))


@query("ref_op87_tokens", f"SELECT conv_id, turn, CAST(len(w) AS INT) AS n, md5(array_to_string(w, ' ')) AS tokens_md5 FROM (SELECT conv_id, turn, {_TOKENS.format('text')} AS w FROM conversations WHERE text IS NOT NULL)")
def tokens(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").filter("text is not null").withColumn("w", relevance.tokens(F.col("text")))
    return c.select("conv_id", "turn", F.size("w").alias("n"), F.md5(F.array_join("w", " ")).alias("tokens_md5"))


@query("ref_op80_matched_terms", f"WITH {_BM25} SELECT conv_id, turn, CAST(matched AS INT) AS matched FROM z")
def matched_terms(spark, sf_dir):
    return _replies(spark, sf_dir).select("conv_id", "turn", relevance.matched_terms(F.col("text"), F.col("context")).alias("matched"))


@query("ref_op89_alpha", "SELECT c_custkey, [0.5, 0.65, 0.6, 0.6, 0.85][c_custkey % 5 + 1]::DOUBLE AS alpha FROM customer")
def alpha(spark, sf_dir):
    """Contexts with nothing exact, an id, a mail address, a host and a UUID, in turn."""
    key = F.col("c_custkey")
    uuid = F.concat(F.lpad(key.cast("string"), 8, "0"), F.lit("-1a2b-3c4d-5e6f-"), F.lpad(key.cast("string"), 12, "a"))
    made = [F.lit("some plain words"), F.concat(F.lit("order "), (key + 10000).cast("string"), F.lit(" of")), F.concat(F.lit("ask c"), key.cast("string"), F.lit("@mail.org now")), F.lit("see db.internal now"), F.concat(F.lit("id "), uuid)]
    context = F.element_at(F.array(*made), (key % 5 + 1).cast("int"))
    return load(spark, sf_dir, "customer").select("c_custkey", relevance.alpha(context).alias("alpha"))


# --- logs -----------------------------------------------------------------------------------------------------------

_NONE = logs.LogOptions(max_errors=0, error_context_lines=0, keep_first_error=False, keep_last_error=False, max_stack_traces=0, max_warnings=0, keep_summary_lines=False)


def _selected(spark, sf_dir, **options):
    parsed = logs.parse_log(logs.explode_lines(log_blocks(spark, sf_dir)))
    return logs.select_lines(parsed, logs.LogOptions(**{**_NONE.__dict__, **options})).filter("selected").select("block_id", "idx")


_TRACES = f"{_STACK}, sr AS (SELECT *, idx - row_number() OVER (PARTITION BY block_id ORDER BY idx) AS g FROM st WHERE is_stack), tr AS (SELECT *, dense_rank() OVER (PARTITION BY block_id ORDER BY g) AS trace, row_number() OVER (PARTITION BY block_id, g ORDER BY idx) AS nth FROM sr)"


@query("ref_op53_stack_traces", f"WITH {_LOGS}, {_TRACES} SELECT block_id, CAST(min(idx) AS INT) AS start, count(*) AS lines FROM tr GROUP BY block_id, trace")
def stack_traces(spark, sf_dir):
    rows = logs.parse_log(logs.explode_lines(log_blocks(spark, sf_dir))).filter("is_stack")
    run = F.col("idx") - F.row_number().over(Window.partitionBy("block_id").orderBy("idx"))
    return rows.withColumn("run", run).groupBy("block_id", "run").agg(F.min("idx").alias("start"), F.count("*").alias("lines")).drop("run")


_SCORE = "least(1.0, CASE level WHEN 'error' THEN 1.0 WHEN 'warn' THEN 0.5 WHEN 'debug' THEN 0.05 WHEN 'trace' THEN 0.02 ELSE 0.1 END + is_stack::INT * 0.3)"


@query("ref_op64_selected_errors", f"""
WITH {_LOGS}, {_STACK}, e AS (SELECT block_id, idx, row_number() OVER w AS nth, count(*) OVER (PARTITION BY block_id) AS n FROM st WHERE level = 'error' WINDOW w AS (PARTITION BY block_id ORDER BY idx))
SELECT block_id, idx FROM e WHERE n <= 10 OR nth <= 9 OR nth = n""")
def selected_errors(spark, sf_dir):
    return _selected(spark, sf_dir, max_errors=10, keep_first_error=True, keep_last_error=True)


@query("ref_op65_selected_warnings", rf"""
WITH {_LOGS}, {_STACK}, w AS (SELECT block_id, idx, regexp_replace(content, '(^[^:=]*[:=]).*$', '\1') AS head, regexp_extract(content, '^[^:=]*') AS pre, content FROM st WHERE level = 'warn'),
t AS (SELECT block_id, min(idx) AS idx FROM w GROUP BY block_id, pre || regexp_replace(regexp_replace(regexp_replace(substr(content, length(pre) + 1), '\d+', 'N', 'g'), '0x[0-9a-fA-F]+', 'ADDR', 'g'), '/[\w/]+/', '/PATH/', 'g'))
SELECT block_id, CAST(idx AS INT) AS idx FROM t QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY idx) <= 5""")
def selected_warnings(spark, sf_dir):
    return _selected(spark, sf_dir, max_warnings=5)


@query("ref_op65_selected_traces", f"WITH {_LOGS}, {_TRACES} SELECT block_id, idx FROM tr WHERE trace <= 3 AND nth <= 20")
def selected_traces(spark, sf_dir):
    return _selected(spark, sf_dir, max_stack_traces=3)


@query("ref_op66_capped_lines", f"""
WITH {_LOGS}, {_STACK}, s AS (SELECT block_id, idx, row_number() OVER (PARTITION BY block_id ORDER BY {_SCORE} DESC, idx) AS rank FROM st) SELECT block_id, idx FROM s WHERE rank <= 20""")
def capped_lines(spark, sf_dir):
    parsed = logs.parse_log(logs.explode_lines(log_blocks(spark, sf_dir))).withColumn("selected", F.lit(True))
    caps = parsed.select("block_id", F.lit(20).alias("cap")).distinct()
    return logs.capped(parsed, caps).filter("selected").select("block_id", "idx")


@query("ref_op67_line_scores", """
WITH s AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 WHEN 3 THEN 0.1 WHEN 4 THEN 0.05 ELSE 0.5 END AS score FROM orders) SELECT o_orderkey, score::DOUBLE AS score FROM s""")
def line_scores(spark, sf_dir):
    """Summary lines of an unknown level, failed summaries, warnings, plain lines, debug lines, and summaries, in turn."""
    key = F.col("o_orderkey")
    made = ["=== short summary", "3 failed of 9", "WARN slow", "plain words", "DEBUG x", "Total time"]
    line = F.element_at(F.array(*map(F.lit, made)), (key % 6 + 1).cast("int"))
    return load(spark, sf_dir, "orders").select("o_orderkey", logs.score_of(logs.level_of(line), F.lit(False), line.rlike(logs.SUMMARY)).alias("score"))


@query("ref_op83_error_neighbours", f"""
WITH {_LOGS}, {_STACK} SELECT DISTINCT a.block_id, a.idx FROM st a JOIN st b ON a.block_id = b.block_id AND b.level = 'error' AND a.idx BETWEEN b.idx - 1 AND b.idx + 1""")
def error_neighbours(spark, sf_dir):
    return _selected(spark, sf_dir, max_errors=1_000_000, error_context_lines=1)


# --- grep output ----------------------------------------------------------------------------------------------------

_KEPT = rf"""{_GREP}, f AS (SELECT block_id, file, count(*) AS n, min(idx) AS first FROM gr GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY n DESC, first) AS rank, least(5, n) AS want FROM f),
b AS (SELECT *, least(5, 100 - coalesce(sum(want) OVER (PARTITION BY block_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS room FROM k WHERE rank <= 20),
m AS (SELECT gr.*, n, room, row_number() OVER (PARTITION BY gr.block_id, gr.file ORDER BY line_no, idx) AS pos FROM gr JOIN b ON b.block_id = gr.block_id AND b.file = gr.file WHERE room > 0),
e AS (SELECT *, CASE WHEN pos = 1 THEN 0 WHEN pos = n THEN 1 ELSE 2 END AS pin, least(1.0, 0.5 + regexp_matches(content || raw, '(?i)\b(error|err|fail|exception|panic|fatal)\b')::INT * 0.5 + regexp_matches(content || raw, '(?i)\b(warn|warning)\b')::INT * 0.4) AS score FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY block_id, file ORDER BY pin, CASE WHEN pin = 2 THEN (context_type <> 'match')::INT ELSE 0 END, CASE WHEN pin = 2 THEN -score ELSE 0 END, pos) AS place FROM e),
kept AS (SELECT * FROM r WHERE place <= room)"""


@query("ref_op60_middle_matches", f"WITH {_KEPT} SELECT block_id, file, raw, CAST(place AS INT) AS place FROM kept WHERE pin = 2")
def middle_matches(spark, sf_dir):
    kept = search.select_matches(search.parse_search(logs.explode_lines(grep_blocks(spark, sf_dir))))
    return kept.filter(F.col("place") > F.least(F.lit(2), F.col("n"))).select("block_id", "file", "raw", "place")


@query("ref_op77_omitted_matches", f"WITH {_KEPT} SELECT block_id, (SELECT count(*) FROM gr WHERE gr.block_id = kept.block_id) - count(*) AS matches, (SELECT count(DISTINCT file) FROM gr WHERE gr.block_id = kept.block_id) - count(DISTINCT file) AS files FROM kept GROUP BY block_id")
def omitted_matches(spark, sf_dir):
    matches = search.parse_search(logs.explode_lines(grep_blocks(spark, sf_dir)))
    left = matches.join(search.select_matches(matches).select("block_id", "idx"), ["block_id", "idx"], "left_anti")
    kept_files = search.select_matches(matches).select("block_id", "file").distinct()
    files = matches.select("block_id", "file").distinct().join(kept_files, ["block_id", "file"], "left_anti").groupBy("block_id").agg(F.count("*").alias("files"))
    of = matches.select("block_id").distinct().join(left.groupBy("block_id").agg(F.count("*").alias("matches")), "block_id", "left").join(files, "block_id", "left")
    return of.select("block_id", F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce("files", F.lit(0)).alias("files"))


_SHORTER = "SELECT t.block_id, CASE WHEN length(result) < length(text) THEN result ELSE text END AS result"

ORACLE_SQL["ref_op96_search_compress"] = f"""
WITH {_KEPT}, t AS (SELECT block_id, string_agg(raw, chr(10) ORDER BY idx) AS text, count(DISTINCT file) AS files FROM gr GROUP BY block_id),
h AS (SELECT block_id, text, files, '{T.HINT}<<ccr:' || substr(sha256(text), 1, 24) || '>>]' AS hint FROM t),
p AS (SELECT block_id, file, any_value(n) AS n, count(*) AS c, string_agg(raw, chr(10) ORDER BY line_no, place) AS body FROM kept GROUP BY ALL),
q AS (SELECT p.block_id, count(*) AS c, string_agg(body || CASE WHEN n > c THEN chr(10) || '[... ' || (n - c) || ' more matches in ' || file || hint ELSE '' END, chr(10) ORDER BY file) AS body FROM p JOIN h ON h.block_id = p.block_id GROUP BY p.block_id),
t2 AS (SELECT h.block_id, text, body || CASE WHEN files > c THEN chr(10) || '[... ' || (files - c) || ' more files with matches omitted' || hint ELSE '' END AS result FROM h JOIN q ON q.block_id = h.block_id)
{_SHORTER} FROM t2 t"""


# --- diffs ----------------------------------------------------------------------------------------------------------


@query("ref_op07_diff_segments", f"WITH {_DIFF} SELECT block_id, CAST(file_id AS BIGINT) AS file_id, CAST(hunk_id AS BIGINT) AS hunk_id, CAST(pos AS INT) AS at, ch AS is_change FROM dl")
def diff_segments(spark, sf_dir):
    return diffs.segment_diff(logs.explode_lines(diff_blocks(spark, sf_dir))).filter("at is not null").select("block_id", "file_id", "hunk_id", "at", "is_change")


_HUNKS = f"{_DIFF}, hs AS (SELECT block_id, file_id, hunk_id, sum(ch::INT) AS changes FROM dl GROUP BY ALL)"


@query("ref_op62_top_files", f"""
WITH {_HUNKS}, fs AS (SELECT block_id, file_id, sum(changes) AS changes FROM hs GROUP BY ALL), r AS (SELECT *, count(*) OVER (PARTITION BY block_id) AS n, row_number() OVER (PARTITION BY block_id ORDER BY changes DESC, file_id) AS place FROM fs)
SELECT block_id, CAST(file_id AS BIGINT) AS file_id, CAST(CASE WHEN n > 10 THEN place ELSE file_id END AS BIGINT) AS rank FROM r WHERE n <= 10 OR place <= 10""")
def top_files(spark, sf_dir):
    hunks = diffs.density(diffs.segment_diff(logs.explode_lines(diff_blocks(spark, sf_dir))))
    files = hunks.groupBy("block_id", "file_id").agg(F.sum("changes").alias("changes"))
    return diffs.top_files(files, 10).select("block_id", "file_id", F.col("rank").cast("long").alias("rank"))


@query("ref_op63_top_hunks", f"""
WITH {_HUNKS}, r AS (SELECT *, count(*) OVER (PARTITION BY block_id, file_id) AS n, row_number() OVER (PARTITION BY block_id, file_id ORDER BY changes DESC, hunk_id) AS p FROM hs)
SELECT block_id, CAST(file_id AS BIGINT) AS file_id, CAST(hunk_id AS BIGINT) AS hunk_id, CAST(CASE WHEN n > 2 THEN p ELSE hunk_id END AS BIGINT) AS place FROM r WHERE n <= 2 OR p <= 2""")
def top_hunks(spark, sf_dir):
    hunks = diffs.density(diffs.segment_diff(logs.explode_lines(diff_blocks(spark, sf_dir))))
    return diffs.top_hunks(hunks, 2).select("block_id", "file_id", "hunk_id", F.col("place").cast("long").alias("place"))


_BODY = "CASE l_returnflag WHEN 'R' THEN '+' WHEN 'A' THEN '-' ELSE ' ' END || 'row ' || l_orderkey"
_DIFF_TEXT = f"""{_DIFF}, dt AS (SELECT *, {_BODY} AS body, row_number() OVER (PARTITION BY block_id ORDER BY l_partkey, l_orderkey, l_linenumber, l_quantity, l_returnflag) AS ord FROM dh)"""


@query("ref_op98_plain_diff", rf"""
WITH {_DIFF_TEXT},
x AS (SELECT block_id, ord, unnest(CASE WHEN head THEN ['--- a/p' || l_partkey, '+++ b/p' || l_partkey, '@@ -1,9 +1,9 @@', body] WHEN l_linenumber = 1 THEN ['@@ -2,9 +2,9 @@', body] ELSE [body] END) AS line, unnest(CASE WHEN head THEN [0, 1, 2, 3] WHEN l_linenumber = 1 THEN [2, 3] ELSE [3] END) AS k FROM dt),
i AS (SELECT block_id, line, row_number() OVER (PARTITION BY block_id ORDER BY ord, k) AS idx, k < 2 AS is_file, k = 2 AS is_hunk, line[1] = ' ' AS ctx FROM x),
c AS (SELECT *, sum(is_file::INT) OVER w AS f, sum((NOT ctx)::INT) OVER w AS run FROM i WINDOW w AS (PARTITION BY block_id ORDER BY idx ROWS UNBOUNDED PRECEDING)),
h AS (SELECT *, sum(is_hunk::INT) OVER (PARTITION BY block_id, f ORDER BY idx ROWS UNBOUNDED PRECEDING) AS hunk, row_number() OVER (PARTITION BY block_id, run, ctx ORDER BY idx) AS nth FROM c),
y AS (SELECT *, is_file OR hunk BETWEEN 1 AND 2 AND (NOT ctx OR nth <= 1) AS kept FROM h),
z AS (SELECT *, coalesce(sum((kept OR is_hunk)::INT) OVER (PARTITION BY block_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM y),
g AS (SELECT block_id, part, sum((NOT kept AND NOT is_hunk)::INT) AS gone, max(CASE WHEN kept THEN line END) AS line FROM z GROUP BY ALL)
SELECT block_id, md5(string_agg(concat_ws(chr(10), CASE WHEN gone > 0 THEN '[... ' || (gone + 1) || ' context lines dropped]' END, line), chr(10) ORDER BY part) FILTER (gone > 0 OR line IS NOT NULL)) AS result_md5 FROM g GROUP BY block_id""")
def plain_diff(spark, sf_dir):
    blocks = diff_blocks(spark, sf_dir, git=False).withColumn("hint", F.lit(""))
    return diffs.plain_diffs(blocks, diffs.DiffOptions(max_context_lines=1, max_hunks_per_file=2)).select("block_id", F.md5("result").alias("result_md5"))


ORACLE_SQL["ref_op97_diff_compress"] = f"""
WITH {_DIFF_TEXT},
ln AS (SELECT block_id, file_id, hunk_id, ord, body, l_partkey, l_returnflag IN ('R', 'A') AS ch, CASE WHEN hunk_id = 1 THEN '@@ -1,9 +1,9 @@' ELSE '@@ -2,9 +2,9 @@' END AS header, head, row_number() OVER (PARTITION BY block_id, file_id, hunk_id ORDER BY ord) - 1 AS pos FROM dt),
t AS (SELECT block_id, string_agg(CASE WHEN head THEN 'diff --git a/p' || l_partkey || ' b/p' || l_partkey || chr(10) || '--- a/p' || l_partkey || chr(10) || '+++ b/p' || l_partkey || chr(10) ELSE '' END || CASE WHEN pos = 0 THEN header || chr(10) ELSE '' END || body, chr(10) ORDER BY ord) AS text FROM ln GROUP BY block_id),
hint AS (SELECT block_id, text, '{T.HINT}<<ccr:' || substr(sha256(text), 1, 24) || '>>]' AS hint FROM t),
b AS (SELECT block_id, file_id, hunk_id, any_value(header) AS header, count(*) AS n, sum(ch::INT) AS changes, min(CASE WHEN ch THEN pos END) AS f, max(CASE WHEN ch THEN pos END) AS l, list(body ORDER BY pos) AS rows FROM ln GROUP BY ALL),
c AS (SELECT b.*, hint, greatest(f - 3, 0) AS s, least(l + 3, n - 1) AS e FROM b JOIN hint ON hint.block_id = b.block_id),
k AS (SELECT *, CASE WHEN f IS NULL THEN concat_ws(chr(10), header, '[... ' || n || ' context-only lines dropped' || hint)
  ELSE concat_ws(chr(10), header, CASE WHEN s > 0 THEN '[... ' || (s + 1) || ' context lines dropped' || hint END, array_to_string(rows[s + 1 : e + 1], chr(10)), CASE WHEN n - 1 - e > 0 THEN '[... ' || (n - e) || ' context lines dropped' || hint END) END AS body,
  count(*) OVER (PARTITION BY block_id, file_id) AS hunks, row_number() OVER (PARTITION BY block_id, file_id ORDER BY changes DESC, hunk_id) AS p FROM c),
fl AS (SELECT block_id, file_id, any_value(hint) AS hint, any_value(hunks) AS hunks, string_agg(body, chr(10) ORDER BY CASE WHEN hunks > 10 THEN p ELSE hunk_id END) FILTER (hunks <= 10 OR p <= 10) AS body FROM k GROUP BY ALL),
fc AS (SELECT block_id, file_id, sum(changes) AS changes FROM b GROUP BY ALL),
fr AS (SELECT fl.*, (SELECT any_value(l_partkey) FROM ln WHERE ln.block_id = fl.block_id AND ln.file_id = fl.file_id) AS p, count(*) OVER (PARTITION BY fl.block_id) AS files, row_number() OVER (PARTITION BY fl.block_id ORDER BY changes DESC, fl.file_id) AS rank FROM fl JOIN fc ON fc.block_id = fl.block_id AND fc.file_id = fl.file_id),
o AS (SELECT block_id, any_value(hint) AS hint, any_value(files) AS files, string_agg('diff --git a/p' || p || ' b/p' || p || chr(10) || '--- a/p' || p || chr(10) || '+++ b/p' || p || chr(10) || body || CASE WHEN hunks > 10 THEN chr(10) || '[... ' || (hunks - 10) || ' hunks omitted' || hint ELSE '' END, chr(10) ORDER BY CASE WHEN files > 10 THEN rank ELSE file_id END) FILTER (files <= 10 OR rank <= 10) AS body FROM fr GROUP BY block_id),
t2 AS (SELECT o.block_id, text, body || CASE WHEN files > 10 THEN chr(10) || '[... ' || (files - 10) || ' files omitted' || o.hint ELSE '' END AS result FROM o JOIN hint ON hint.block_id = o.block_id)
{_SHORTER} FROM t2 t"""


# --- store and cache ------------------------------------------------------------------------------------------------


def _entries(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    fresh = d.select(T.content_key(F.col("text")).alias("hash"), F.col("text").alias("payload"), (1000 + F.col("doc_id") * 37 % 600).alias("created_at"))
    return store.upserted(fresh.limit(0), fresh)


_ENTRIES = "n AS (SELECT substr(sha256(text), 1, 24) AS hash, any_value(text) AS payload, max(1000 + doc_id * 37 % 600) AS made FROM documents GROUP BY 1)"


@query("ref_op11_store_size", f"WITH {_ENTRIES} SELECT count(*) AS size FROM n")
def store_size(spark, sf_dir):
    return _entries(spark, sf_dir).agg(F.count("*").alias("size"))


@query("ref_op12_store_purge", f"WITH {_ENTRIES} SELECT hash, made AS created_at FROM n WHERE made >= 1500 - 300")
def store_purge(spark, sf_dir):
    return store.purged(_entries(spark, sf_dir), F.lit(1500)).select("hash", "created_at")


@query("ref_op79_retrieve", f"""
WITH {_ENTRIES}, q AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN md5(CAST(doc_id AS VARCHAR)) ELSE substr(sha256(text), 1, 24) END AS hash FROM documents)
SELECT doc_id, md5(CASE WHEN n.made > 1600 - 300 AND n.payload <> '' THEN n.payload ELSE 'No cached content found for hash ' || q.hash || '. The entry may have expired (TTL: 5 minutes) or the hash is invalid.' END) AS output_md5 FROM q LEFT JOIN n ON n.hash = q.hash""")
def retrieve(spark, sf_dir):
    """A third of the requests asks for hashes that were never stored, others for expired ones."""
    asked = load(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.md5(F.col("doc_id").cast("string"))).otherwise(T.content_key(F.col("text"))).alias("hash"))
    return store.retrieve(asked, _entries(spark, sf_dir), F.lit(1600)).select("doc_id", F.md5("output").alias("output_md5"))


@query("ref_op109_ttl_capacity", f"""
WITH {_ENTRIES}, p AS (SELECT hash, made FROM n WHERE made >= 1500 - 300) SELECT hash, made AS created_at FROM p QUALIFY (SELECT count(*) FROM p) <= 50 OR row_number() OVER (ORDER BY made DESC, hash) <= 46""")
def ttl_capacity(spark, sf_dir):
    return store.evicted(store.purged(_entries(spark, sf_dir), F.lit(1500)), 50).select("hash", "created_at")


@query("ref_op49_cache_counters", """
WITH k AS (SELECT doc_id, lag(doc_id) OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS p FROM documents), o AS (SELECT CASE WHEN p IS NULL THEN 'miss' WHEN (doc_id - p) * 1000 < 100000 THEN 'hit' ELSE 'evicted' END AS outcome FROM k)
SELECT sum((outcome = 'hit')::INT)::BIGINT AS cache_hits, 0::BIGINT AS cache_skip_hits, sum((outcome <> 'hit')::INT)::BIGINT AS cache_misses, sum((outcome = 'evicted')::INT)::BIGINT AS cache_evictions FROM o""")
def cache_counters(spark, sf_dir):
    return cache.counters(cache_tiers(spark, sf_dir).withColumn("action", F.lit("get")))
