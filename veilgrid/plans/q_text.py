"""Queries: text, chat, streams, user functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mechanisms as N
from ..functions.dialect import DUCK, SPARK
from ..operators import chat as C
from ..operators import metrics as M
from ..operators import text as X
from ..operators.derive import with_derived
from ..operators.patterns import without_fragments
from ..operators.release import targets
from ..sources import scratch
from ..sources.tables import patients, patients_sql, table
from ..streaming import releases as ST
from .base import CLASSES, observations, observations_sql, portable, query, rounded
from .catalog import SYNONYMS, Template, register_template, templates
from .q_release import P

D = DUCK


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


# Text ---------------------------------------------------------------------------------------------------------------


@query("txt1_first_word", "SELECT doc_id, sha256(regexp_replace(text, '\\bthe\\b', '<THE>')) AS h FROM documents")
def txt1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.sha2(X.first_word_replaced(F.col("text"), F.lit("the"), F.lit("<THE>")), 256).alias("h"))


EMAIL = "([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,})"
FOUND = f"list_sort(list_distinct(regexp_extract_all(nfc_normalize(text), '{EMAIL}', 1)))"
LONGEST_FIRST = "list_transform(list_sort(list_transform({found}, lambda e: lpad((100000 - length(e))::VARCHAR, 6, '0') || e)), lambda e: substring(e, 7))"
HIDDEN = f"list_reduce(list_prepend(nfc_normalize(text), {LONGEST_FIRST.format(found=FOUND)}), lambda t, e: replace(t, e, '<email:' || substring(sha256('veil:email:' || e), 1, 12) || '>'))"


@query("txt2_pseudonymise", f"SELECT doc_id, len({FOUND}) AS entities, sha256({HIDDEN}) AS h FROM documents")
def txt2(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    pairs = X.mapping(d, ["email"])
    n = F.size(F.array_distinct(F.regexp_extract_all("original", F.lit(X.PATTERNS["email"]), 1))).cast("long")
    return X.pseudonymise(d.withColumn("original", F.col("text")), pairs).select("doc_id", n.alias("entities"), F.sha2("text", 256).alias("h"))


@query("txt3_restore", "SELECT doc_id, sha256(nfc_normalize(text)) AS h, true AS hidden FROM documents")
def txt3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose entities were hidden and restored; hidden: no entity was left in between."""
    d = docs(spark, sf_dir)
    pairs = scratch.written(X.mapping(d, ["email", "ip", "token"]))
    away = X.pseudonymise(d, pairs)
    left = F.coalesce(F.size(F.regexp_extract_all("text", F.lit(X.PATTERNS["email"]), 1)), F.lit(0)) + F.coalesce(F.size(F.regexp_extract_all("text", F.lit(X.PATTERNS["ip"]), 1)), F.lit(0))
    back = X.restore(away.withColumn("hidden", left <= 0), pairs)
    return back.select("doc_id", F.sha2("text", 256).alias("h"), "hidden")


AMOUNT = "o_totalprice::DECIMAL(18,2)::VARCHAR"


@query("txt3_number_forms", f"SELECT o_orderkey, 'paid ' || {AMOUNT} || ' today' AS text FROM orders")
def txt3n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts that were hidden behind numeric tokens come back although the reply wrote comma for dot, or left separators out."""
    amount = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    o = table(spark, sf_dir, "orders").select("o_orderkey", amount.alias("entity"), F.concat(F.lit("7,"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"), F.lit(".25")).alias("token"))
    form = F.get(X.number_forms(F.col("token")), (F.col("o_orderkey") % 4).cast("int"))
    said = o.select("o_orderkey", F.concat(F.lit("paid "), form, F.lit(" today")).alias("text"))
    return X.restore(said, o.withColumn("kind", F.lit("money")), "o_orderkey").select("o_orderkey", "text")


SHIFT = "(ascii(d) - 48 + ('0x' || substring(sha256('veil:' || o_orderkey), i, 1))::INT) % 10"


@query("txt4_digit_tokens", f"WITH n AS (SELECT o_orderkey, o_totalprice::DECIMAL(18,2)::VARCHAR AS original FROM orders), c AS (SELECT o_orderkey, original, i, substring(original, i, 1) AS d FROM (SELECT *, unnest(range(1, length(original) + 1)) AS i FROM n)) SELECT o_orderkey, original, string_agg(CASE WHEN d BETWEEN '0' AND '9' THEN ({SHIFT})::VARCHAR ELSE d END, '' ORDER BY i) AS token FROM c GROUP BY 1, 2")
def txt4(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", number.alias("original"), X.shifted_digits(number, F.col("o_orderkey").cast("string")).alias("token"))


for _kind, _pattern in (("age", r"\b(\d{1,3})\b"), ("zipcode", r"\b(\d{5}(?:-\d{4})?)\b"), ("email", X.PATTERNS["email"]), ("ip", X.PATTERNS["ip"]), ("token", X.PATTERNS["token"])):

    def _entities(spark: SparkSession, sf_dir: str, kind: str = _kind) -> DataFrame:
        return X.entities(docs(spark, sf_dir), kind).groupBy("doc_id", "entity").agg(F.count(F.lit(1)).alias("n"))

    query(f"txt5_{_kind}", f"SELECT doc_id, entity, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_pattern}', 1)) AS entity FROM documents) GROUP BY 1, 2")(_entities)


@query("txt5_money", "SELECT o_orderkey, regexp_extract('USD ' || o_totalprice::DECIMAL(18,2)::VARCHAR, '([-+]?[0-9]+(,[0-9]+)*(\\.[0-9]+)?)', 1) AS entity FROM orders")
def txt5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("USD "), F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("text"))
    return X.entities(o, "money", "o_orderkey").select("o_orderkey", "entity")


@query("txt5_money_documents", "SELECT doc_id, entity, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '[a-zA-Z]', '', 'g'), '([-+]?\\d+(?:,\\d+)*(?:\\.\\d+)?)', 1)) AS entity FROM documents) GROUP BY 1, 2")
def txt5d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.entities(docs(spark, sf_dir), "money").groupBy("doc_id", "entity").agg(F.count(F.lit(1)).alias("n"))


TITLED = "(['Dr. ', 'Mrs. ', 'Prof ', ''])[c_custkey % 4 + 1] || c_name"


@query("txt6_titles", "SELECT c_custkey, c_name AS name FROM customer")
def txt6(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = F.array(*[F.lit(x) for x in ("Dr. ", "Mrs. ", "Prof ", "")])
    titled = F.concat(F.get(titles, (F.col("c_custkey") % 4).cast("int")), F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", X.without_titles(titled).alias("name"))


@query("txt7_first_position", "SELECT doc_id, coalesce(list_position(['de', 'fr', 'és', 'en', 'es'], nfc_normalize(CASE WHEN doc_id % 7 = 0 THEN 'e' || chr(769) || 's' ELSE lang END)), 0)::BIGINT AS place FROM documents")
def txt7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first place of a name among others, after both are in composed form: some come with a combining accent."""
    d = table(spark, sf_dir, "documents")
    name = X.composed(F.when(F.col("doc_id") % 7 == 0, F.lit("e\u0301s")).otherwise(F.col("lang")))
    names = F.array(*[F.lit(x) for x in ("de", "fr", "\u00e9s", "en", "es")])
    return d.withColumn("name", name).select("doc_id", F.coalesce(F.array_position(names, F.col("name")), F.lit(0)).cast("long").alias("place"))


@query("txt8_after_last", "SELECT conv_id, turn, sha256(trim(string_split(text, '. ')[-1], ' ')) AS h FROM conversations")
def txt8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(X.after_last(F.col("text"), ". "), 256).alias("h"))


REPLY = "config = 'roots' AND b_setting = 'k+1' AND eps = 1.0"


@query("txt9_reply_values", f"WITH {observations_sql()} SELECT template, patient_id, root, round(released, 2) AS value FROM obs WHERE {REPLY}")
def txt9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases written out as replies, some under synonyms, and read back."""
    o = observations(spark, sf_dir).where(REPLY).withColumn("v", F.format_string("%.2f", F.round("released", 2)))
    other = F.create_map(*[F.lit(x) for kv in {v: k for k, v in SYNONYMS.items()}.items() for x in kv])
    name = F.when(F.col("patient_id") % 2 == 0, F.coalesce(other[F.col("root")], F.col("root"))).otherwise(F.upper("root"))
    line = F.concat(name, F.when(F.col("patient_id") % 3 == 0, " = ").otherwise(": "), F.col("v"))
    replies = o.groupBy("template", "patient_id").agg(F.array_join(F.collect_list(line), "\n").alias("reply"))
    synonyms = spark.createDataFrame(sorted(SYNONYMS.items()), "name string, stem string")
    roots = spark.createDataFrame([(t.name, r) for t in templates().values() for r in t.roots], "template string, root string")
    return X.reply_values(replies, synonyms, roots, ["template", "patient_id"])


@query("txt10_final_class", "SELECT o_orderkey, (o_orderkey % 3)::BIGINT AS class FROM orders")
def txt10(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("So the answer is\nfinal_class = "), (F.col("o_orderkey") % 3).cast("string"), F.lit(" ."))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.regexp_extract(said, X.FINAL_CLASS, 1).cast("long").alias("class"))


@query("txt11_prompts", f"WITH {observations_sql()} SELECT template, patient_id, 'Values:' || chr(10) || string_agg('  ' || root || ' = ' || idx, chr(10) ORDER BY root) AS prompt FROM obs WHERE {REPLY} GROUP BY 1, 2")
def txt11(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir).where(REPLY)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("root", "idx"))), lambda x: F.concat(F.lit("  "), x["root"], F.lit(" = "), x["idx"].cast("string")))
    return o.groupBy("template", "patient_id").agg(F.concat(F.lit("Values:\n"), F.array_join(lines, "\n")).alias("prompt"))


STOPS = "(SELECT n_name AS fragment FROM nation UNION SELECT right(c_name, 2) FROM customer WHERE c_acctbal < -990 UNION SELECT '#0000000077')"


@query("txt12_name_dictionary", f"SELECT x.name, count(*) AS n FROM (SELECT c_name AS name FROM customer UNION SELECT s_name FROM supplier) x WHERE NOT EXISTS (SELECT 1 FROM {STOPS} f WHERE contains(x.name, f.fragment)) GROUP BY x.name")
def txt12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names of customers and suppliers that hold none of the stop fragments, a table."""
    c = table(spark, sf_dir, "customer")
    names = c.select(F.col("c_name").alias("name")).unionByName(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))).distinct()
    stops = table(spark, sf_dir, "nation").select(F.col("n_name").alias("fragment")).unionByName(c.where("c_acctbal < -990").select(F.expr("right(c_name, 2)").alias("fragment"))).unionByName(spark.createDataFrame([("#0000000077",)], "fragment string"))
    return without_fragments(names, stops).groupBy("name").agg(F.count(F.lit(1)).alias("n"))



# Chat ---------------------------------------------------------------------------------------------------------------

BASE = "c AS (SELECT conv_id, coalesce(min_by(CASE WHEN role = 'system' THEN text END, CASE WHEN role = 'system' THEN turn END), '') AS sys FROM conversations GROUP BY 1), t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations WHERE role <> 'system')"
SEP = "CASE WHEN i % 2 = 1 THEN '</s>' ELSE ' ' END"
#: What each style is in SQL: head (of sys), and a turn that was said (of role, text, i).
CHAT_SQL = {
    "add_colon_single": ("sys || ' '", "role || ': ' || text || ' '"),
    "add_colon_two": ("sys || ' '", f"role || ': ' || text || {SEP}"),
    "add_colon_space_single": ("sys || ' '", "role || ': ' || text || ' '"),
    "add_new_line_single": ("CASE WHEN sys = '' THEN '' ELSE sys || ' ' END", "role || chr(10) || text || ' '"),
    "no_colon_single": ("sys", "role || text || ' '"),
    "no_colon_two": ("sys", f"role || text || {SEP}"),
    "rwkv": ("sys", "role || ': ' || replace(replace(text, chr(13) || chr(10), chr(10)), chr(10) || chr(10), chr(10)) || chr(10) || chr(10)"),
    "llama2": ("CASE WHEN sys = '' THEN '[INST] ' ELSE sys END", f"CASE WHEN i = 0 THEN text || ' ' ELSE role || ' ' || text || {SEP} END"),
    "llama3": ("'<|begin_of_text|>' || sys", "'<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || trim(text, ' ') || '<|eot_id|>'"),
    "chatglm": ("CASE WHEN sys = '' THEN '' ELSE sys || ' ' END", "CASE WHEN i % 2 = 0 THEN '[Round ' || (i // 2) || '] ' ELSE '' END || role || '：' || text || ' '"),
    "chatml": ("CASE WHEN sys = '' THEN '' ELSE sys || ' ' || chr(10) END", "role || chr(10) || text || ' ' || chr(10)"),
    "chatglm3": ("sys", "role || chr(10) || text"),
    "chatintern": ("sys", f"CASE WHEN i % 2 = 0 THEN '<s>' ELSE '' END || role || ':' || text || {SEP} || chr(10)"),
    "dolly": ("sys", f"role || ':' || chr(10) || text || {SEP} || CASE WHEN i % 2 = 1 THEN chr(10) || chr(10) ELSE '' END"),
    "phoenix": ("sys", "role || ': <s>' || text || '</s>'"),
    "robin": ("sys || ' '", "role || ':' || chr(10) || text || ' '"),
    "falcon_chat": ("CASE WHEN sys = '' THEN '' ELSE sys || ' ' END", "role || ': ' || text || ' '"),
    "metamath": ("CASE WHEN sys = '' THEN '' ELSE sys || ' ' END", "CASE WHEN i % 2 = 0 THEN role || ':' || chr(10) || text || ' ' ELSE role || ': </s>' || text END"),
    "deepseek_chat": ("sys", f"role || ': ' || text || {SEP}"),
    "yuan2": ("CASE WHEN sys = '' THEN '' ELSE sys || '</s>' END", "text || '<n>'"),
    "gemma": ("'<bos>'", "'<start_of_turn>' || role || chr(10) || text || ' '"),
    "cllm": ("sys || ' '", "role || ': ' || text || CASE WHEN (i - greatest(n - 2, 0)) % 2 = 1 THEN '</s>' ELSE ' ' END"),
    "default": ("sys || chr(10)", "role || ': ' || text || chr(10)"),
}


def chat_sql(style: str) -> str:
    head, said = CHAT_SQL[style]
    only = "WHERE i >= n - 2" if style == "cllm" else ""
    body = f"(SELECT conv_id, string_agg({said}, '' ORDER BY i) AS body FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM t) {only} GROUP BY 1)"
    text = f"{head} || coalesce(body, '')"
    if style == "yuan2":
        text = f"{head} || regexp_replace(coalesce(body, ''), '[<n>]+$', '') || ' '"
    return f"WITH {BASE} SELECT conv_id, sha256({text}) AS h FROM c LEFT JOIN {body} b USING (conv_id)"


for _style in C.STYLES:

    def _render(spark: SparkSession, sf_dir: str, style: str = _style) -> DataFrame:
        c = C.conversations(table(spark, sf_dir, "conversations"))
        return c.select("conv_id", F.sha2(C.render(F.col("messages"), F.col("system"), style), 256).alias("h"))

    query(f"cht1_{_style}", chat_sql(_style))(_render)


for _api, _assistant in (("openai", "assistant"), ("gemini", "model"), ("metagen", "ai")):

    def _api_messages(spark: SparkSession, sf_dir: str, assistant: str = _assistant) -> DataFrame:
        c = C.conversations(table(spark, sf_dir, "conversations"))
        m = c.select("conv_id", F.posexplode(C.api_messages(F.col("messages"), F.col("system"), assistant)).alias("place", "m"))
        return m.select("conv_id", F.col("place").cast("long").alias("place"), "m.role", F.sha2("m.content", 256).alias("h"))

    query(f"cht2_{_api}", f"WITH {BASE} SELECT conv_id, 0::BIGINT AS place, 'system' AS role, sha256(sys) AS h FROM c WHERE sys <> '' UNION ALL SELECT conv_id, i + (sys <> '')::INT, CASE WHEN i % 2 = 0 THEN 'user' ELSE '{_assistant}' END, sha256(text) FROM t JOIN c USING (conv_id)")(_api_messages)


@query("cht3_pairs", f"WITH {BASE} SELECT a.conv_id, a.i // 2 AS pair, sha256(a.text) AS u, sha256(b.text) AS answer FROM t a LEFT JOIN t b ON a.conv_id = b.conv_id AND b.i = a.i + 1 WHERE a.i % 2 = 0")
def cht3(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = C.conversations(table(spark, sf_dir, "conversations"))
    p = c.select("conv_id", F.posexplode(C.pairs(F.col("messages"))).alias("pair", "p"))
    return p.select("conv_id", F.col("pair").cast("long").alias("pair"), F.sha2("p.user", 256).alias("u"), F.sha2("p.answer", 256).alias("answer"))


@query("cht4_edits", f"WITH {BASE} SELECT conv_id, count(i)::BIGINT AS turns, sha256(coalesce(string_agg(CASE WHEN i = n - 1 THEN 'changed' ELSE text END, '|' ORDER BY i) FILTER (i >= 1), '') ) AS h FROM c LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM t) USING (conv_id) GROUP BY 1")
def cht4(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = C.conversations(table(spark, sf_dir, "conversations"))
    changed = C.last_replaced(F.col("messages"), F.lit("changed"))
    rest = F.slice(changed, 2, 1_000_000)
    more = F.size(C.appended(F.col("messages"), "user", F.lit("more"))) - 1
    return c.select("conv_id", more.cast("long").alias("turns"), F.sha2(F.array_join(F.transform(rest, lambda x: x["text"]), "|"), 256).alias("h"))


# Streams ------------------------------------------------------------------------------------------------------------


def streamed(spark: SparkSession, sf_dir: str, transform: Callable[[DataFrame], DataFrame], mode: str = "append", batches: int = 4, delay: str = "0L") -> DataFrame:
    """The events as a stream of several files in order of arrival, a micro-batch each, run to its end into a table, and read.

    delay: SQL for the microseconds by which an event arrives after its time.
    """
    events = table(spark, sf_dir, "events")
    source = scratch.new_folder(spark)
    at = F.unix_micros(F.col("ts").cast("timestamp")) + F.expr(delay)
    low, high = events.agg(F.min(at), F.max(at)).first()
    width = ((high or 0) - (low or 0)) // batches + 1
    for k in range(batches):
        events.where((at >= (low or 0) + k * width) & (at < (low or 0) + (k + 1) * width)).coalesce(1).write.mode("append").parquet(source)
    sink, marks = scratch.new_folder(spark), scratch.new_folder(spark)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    started = transform(stream).writeStream.format("parquet").option("checkpointLocation", marks).option("path", sink).outputMode(mode).trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.parquet(sink)


LO, HI, EPS = 0.0, 100.0, 0.5
EVENT_T = N.grid_position(D, N.clip("value", D.num(LO), D.num(HI)), D.num(LO), D.num(HI))
EVENT_SQL = f"ev AS (SELECT *, {N.exponential(D, EVENT_T, D.num(EPS), D.uniform(chr(39) + 'events' + chr(39), 'event_id'))} AS idx FROM events), rel AS (SELECT *, {N.value_of(D, 'idx', D.num(LO), D.num(HI))} AS released FROM ev)"


@query("str1_released_stream", f"WITH {EVENT_SQL} SELECT event_id, user_id, idx FROM rel")
def str1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamed(spark, sf_dir, lambda s: ST.released_events(s, EPS, LO, HI)).select("event_id", "user_id", "idx")


@query("str1_released_batch", f"WITH {EVENT_SQL} SELECT event_id, user_id, idx FROM rel")
def str1b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.released_events(table(spark, sf_dir, "events"), EPS, LO, HI).select("event_id", "user_id", "idx")


@query("str2_ledger_stream", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 50 AS allowed FROM events")
def str2(spark: SparkSession, sf_dir: str) -> DataFrame:
    spend = lambda s: ST.spend_within(s.withColumn("eps", F.lit(0.1)).select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "eps"), 5.0)
    return streamed(spark, sf_dir, spend).select("event_id", "user_id", "allowed")


PASSED = "epoch_us(ts) <= (SELECT epoch_us(max(ts)) // 1000 * 1000 - 86400000000 FROM events)"


@query("str2_ledger_in_order", f"SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 50 AS allowed FROM events WHERE {PASSED}")
def str2_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive up to 20 hours late, in other batches than their time's, are charged in order of their times once the watermark has passed them."""
    own = ST.ledger_session(spark)
    spend = lambda s: ST.charged_in_order(s.withColumn("eps", F.lit(0.1)).select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "eps"), 5.0)
    return streamed(own, sf_dir, spend, delay="pmod(xxhash64(event_id), 72000) * 1000000").select("event_id", "user_id", "allowed")


@query("str3_windows", f"WITH {EVENT_SQL} SELECT epoch(date_trunc('day', ts))::BIGINT AS start, count(*) AS n, round(100 * sum(abs(released - value)) / sum(abs(value)), 3) AS wmape FROM rel GROUP BY 1")
def str3(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ST.released_events(table(spark, sf_dir, "events"), EPS, LO, HI).withColumn("ts", F.col("ts").cast("timestamp"))
    return ST.utility_windows(r).select(F.unix_timestamp("start").alias("start"), "n", F.round("wmape", 3).alias("wmape"))


@query("str3_windows_stream", f"WITH {EVENT_SQL} SELECT epoch(date_trunc('day', ts))::BIGINT AS start, count(*) AS n, round(100 * sum(abs(released - value)) / sum(abs(value)), 3) AS wmape FROM rel WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1")
def str3s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on a stream: a window is told once the watermark, a day behind the latest event, has passed its end."""
    r = lambda s: ST.utility_windows(ST.released_events(s, EPS, LO, HI).withColumn("ts", F.col("ts").cast("timestamp")), watermark="1 day")
    return streamed(spark, sf_dir, r).select(F.unix_timestamp("start").alias("start"), "n", F.round("wmape", 3).alias("wmape"))


# User functions -----------------------------------------------------------------------------------------------------


@query("udf1_expression", "SELECT o_orderkey, round(ln(o_totalprice) * 2, 5) AS v FROM orders")
def udf1(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Template("LOGS", ["o_totalprice"], {"o_totalprice": (1.0, 1e6)}, [("logged", "ln(o_totalprice)", {"o_totalprice": "1 / o_totalprice"}), ("doubled", "logged * 2", {"logged": "2"})], "doubled")
    return with_derived(table(spark, sf_dir, "orders"), t).select("o_orderkey", F.round("doubled", 5).alias("v"))


@query("udf2_template", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice / l_quantity, 9) AS unit FROM lineitem WHERE l_quantity <> 0")
def udf2(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Template("UNIT", ["l_extendedprice", "l_quantity"], {"l_extendedprice": (0.0, 1e6), "l_quantity": (1.0, 50.0)}, [("unit", "l_extendedprice / l_quantity", {"l_extendedprice": "1 / l_quantity", "l_quantity": "-l_extendedprice / (l_quantity * l_quantity)"})], "unit")
    return with_derived(table(spark, sf_dir, "lineitem"), t).where("unit IS NOT NULL").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("unit", 9).alias("unit"))


@query(
    "udf3_any_statistic",
    f"""WITH r AS (SELECT o_orderpriority AS p, {M.bucket_sql(D, 'o_orderkey')} AS g, count(*) AS n, sum(o_totalprice) AS v, sum((o_totalprice > 100000)::INT) AS big FROM orders GROUP BY 1, 2),
    w AS MATERIALIZED (SELECT g, b, CASE WHEN b = 0 THEN 1 ELSE {M.poisson_weight(D, 'dg', 'b')} END AS w FROM (SELECT g, b, {M.digest_sql(D, 'g', f'((b // {M.SHARED}) * {M.SHARED})')} AS dg FROM range({M.BUCKETS}) x(g) CROSS JOIN range(51) y(b))),
    s AS (SELECT p, b, sum(w * v) / sum(w * n) AS mean, 100.0::DOUBLE * sum(w * big) / sum(w * n) AS large FROM r JOIN w USING (g) GROUP BY 1, 2),
    l AS (SELECT p, b, 'mean' AS name, mean AS s FROM s UNION ALL SELECT p, b, 'large', large FROM s)
    SELECT p AS o_orderpriority, name, round(max(CASE WHEN b = 0 THEN s END), 2) AS value, round(stddev_samp(CASE WHEN b > 0 THEN s END), 3) AS se FROM l GROUP BY 1, 2""",
)
def udf3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any statistic that is a function of sums, with its error."""
    sums = {"v": F.col("o_totalprice"), "big": (F.col("o_totalprice") > 100000).cast("int")}
    statistics = {"mean": lambda s: F.try_divide(s["v"], s["n"]), "large": lambda s: F.try_divide(100.0 * s["big"], s["n"])}
    out = M.bootstrap(table(spark, sf_dir, "orders"), "o_orderkey", sums, statistics, ("o_orderpriority",), 50)
    return out.select("o_orderpriority", "name", F.round("value", 2).alias("value"), F.round("se", 3).alias("se"))
