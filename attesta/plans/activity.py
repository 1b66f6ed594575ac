"""Catalogue: scores, progress and event runs. Events stand for the clicks of a user; `props.k`
modulo 10 is the question, `signup` a restart."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.functions import text as tx
from attesta.operators import page_log as logged
from attesta.operators import progress, scan
from attesta.plans.content import table
from attesta.sources.readers import table_stream
from attesta.sources.sinks import drop_at_exit, shared_folder
from attesta.streaming import page_log
from attesta.streaming.progress_stream import replay
from attesta.streaming.runs import drained

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Question -> its correct answer.
TYPES = ("view", "click", "error", "purchase", "signup")


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def asked(spark, sf) -> DataFrame:
    """Events with the question that they answer."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf, "events").withColumn("k", k).withColumn("question_id", k % 10)


@query(
    "q22_score",
    """WITH e AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS question_id, event_type, ts, event_id FROM events),
            a AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, question_id ORDER BY ts, event_id) = 1),
            q AS (SELECT unnest(range(0, 10)) AS question_id),
            k AS (SELECT question_id, ['view', 'click', 'error', 'purchase', 'signup'][question_id % 5 + 1] AS correct FROM q),
            u AS (SELECT DISTINCT user_id FROM events)
       SELECT user_id, count(*) FILTER (WHERE event_type = correct) AS score, count(*) AS total, printf('%d/%d', count(*) FILTER (WHERE event_type = correct), count(*)) AS label
       FROM u CROSS JOIN k LEFT JOIN a USING (user_id, question_id) GROUP BY user_id""",
)
def q22(spark, sf):
    events = asked(spark, sf)
    answers = progress.first_answers(events, ["user_id", "question_id"], ["ts", "event_id"]).select("user_id", "question_id", F.col("event_type").alias("answer"))
    questions = spark.range(10).select(F.col("id").alias("question_id"), F.element_at(F.array(*map(F.lit, TYPES)), (F.col("id") % 5 + 1).cast("int")).alias("correct"))
    return progress.score(questions, answers, events.select("user_id").distinct()).withColumn("label", progress.score_text(F.col("score"), F.col("total")))


@query("q23_first_answer_wins", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def q23(spark, sf):
    return progress.first_answers(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query(
    "q24_runs_by_restart",
    """SELECT user_id, CAST(run AS BIGINT) AS run, count(*) AS n, count(DISTINCT event_type) AS n_types
       FROM (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events)
       GROUP BY user_id, run""",
)
def q24(spark, sf):
    rows = progress.with_runs(table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "signup")
    return rows.groupBy("user_id", "run").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("n_types"))


PREFIX_SQL = """
    (SELECT l_orderkey, coalesce(min(pos) FILTER (WHERE NOT l_quantity < 40) - 1, count(*)) AS answered, count(*) AS total
     FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos FROM lineitem) GROUP BY l_orderkey)
"""


def prefixes(spark, sf) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = table(spark, sf, "lineitem").withColumn("pos", F.row_number().over(w))
    return progress.valid_prefix(rows, "l_orderkey", "pos", F.col("l_quantity") < 40)


@query("q25_valid_prefix", f"SELECT * FROM {PREFIX_SQL}")
def q25(spark, sf):
    return prefixes(spark, sf)


@query(
    "q26_resume_position",
    f"""WITH p AS (SELECT *, o_custkey % 9 - 1 AS stored, o_orderstatus = 'F' AND answered = total AS done,
                          CASE WHEN answered < total THEN answered ELSE greatest(total - 1, 0) END AS following FROM {PREFIX_SQL} JOIN orders ON o_orderkey = l_orderkey)
        SELECT l_orderkey, CASE WHEN done THEN greatest(total - 1, 0) WHEN stored >= 0 AND (stored = answered - 1 OR stored = following) THEN stored ELSE following END AS idx,
               done AS completed, done OR answered > 0 OR stored > 0 AS restored FROM p""",
)
def q26(spark, sf):
    rows = prefixes(spark, sf).join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    index, done, restored = progress.resume(F.col("answered"), F.col("total"), F.col("o_custkey") % 9 - 1, F.col("o_orderstatus") == "F")
    return rows.select("l_orderkey", index.alias("idx"), done.alias("completed"), restored.alias("restored"))


@query(
    "q27_label_lookup",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'Eventos' WHEN 'click' THEN 'Personajes' ELSE event_type END || ' · Dificultad ' || lower(CASE event_type WHEN 'error' THEN 'Inicial' ELSE event_type END) AS caption
       FROM events""",
)
def q27(spark, sf):
    c = F.col("event_type")
    return table(spark, sf, "events").select(
        "event_id", F.concat(tx.label(c, {"view": progress.CATEGORY_NAMES["eventos"], "click": progress.CATEGORY_NAMES["personajes"]}), F.lit(" · Dificultad "), F.lower(tx.label(c, {"error": progress.DIFFICULTY_NAMES["beginner"]}))).alias("caption")
    )


@query(
    "q28_option_state",
    """SELECT l_orderkey, l_linenumber, upper(l_linestatus) AS marker,
              CASE WHEN l_linenumber = c AND l_linenumber = s THEN 'Respuesta correcta y seleccionada.' WHEN l_linenumber = c THEN 'Respuesta correcta.'
                   WHEN l_linenumber = s THEN 'Tu respuesta, incorrecta.' ELSE '' END AS state,
              CASE WHEN c = s THEN 'Correcto. Revisa el contexto y la referencia antes de continuar.'
                   ELSE 'No es correcto. La respuesta es ' || c || '. Revisa el contexto y la referencia.' END AS feedback
       FROM (SELECT *, 1 + l_partkey % 7 AS c, 1 + l_suppkey % 7 AS s FROM lineitem)""",
)
def q28(spark, sf):
    rows = table(spark, sf, "lineitem").withColumns({"o": F.col("l_linenumber").cast("bigint"), "c": 1 + F.col("l_partkey") % 7, "s": 1 + F.col("l_suppkey") % 7})
    return rows.select(
        "l_orderkey", "l_linenumber", F.upper("l_linestatus").alias("marker"),
        progress.option_state(F.col("o"), F.col("c"), F.col("s")).alias("state"),
        progress.feedback(F.col("c").cast("string"), F.col("c") == F.col("s"), F.lit(False)).alias("feedback"),
    )


#: What an event stands for in the quiz of ten questions; the letter of k modulo 4 is the option.
QUIZ_EVENTS = {"view": "select", "click": "check", "purchase": "next", "signup": "restart", "error": "reload"}
QUIZ = [(f"q{i}", list("abcd"), "abcd"[i % 4]) for i in range(10)]


@query(
    "q45_progress_stream",
    """WITH RECURSIVE e AS (
           SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type, substr('abcd', CAST(CAST(json_extract(props, '$.k') AS BIGINT) % 4 + 1 AS INT), 1) AS option FROM events
       ), s AS (
           SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, 0 AS run, 0 AS n_events, 0 AS idx, '' AS selected, '' AS given, false AS completed, false AS kept FROM events
           UNION ALL
           SELECT s.user_id, e.n, run + CASE WHEN e.event_type = 'signup' THEN 1 ELSE 0 END, CASE WHEN e.event_type = 'signup' THEN 1 ELSE n_events + 1 END,
                  CASE WHEN e.event_type = 'signup' THEN 0 WHEN e.event_type = 'purchase' AND length(given) > idx AND idx < 9 THEN idx + 1 ELSE idx END,
                  CASE WHEN e.event_type = 'signup' THEN '' WHEN completed THEN selected WHEN e.event_type = 'view' AND length(given) = idx THEN e.option
                       WHEN e.event_type = 'error' OR (e.event_type = 'purchase' AND length(given) > idx AND idx < 9) THEN '' ELSE selected END,
                  CASE WHEN e.event_type = 'signup' THEN '' WHEN e.event_type = 'click' AND NOT completed AND length(given) = idx THEN given || selected ELSE given END,
                  e.event_type <> 'signup' AND (completed OR (e.event_type = 'purchase' AND idx = 9 AND length(given) = 10)),
                  e.event_type <> 'signup' AND (kept OR (e.event_type = 'click' AND length(given) = idx AND selected <> '') OR (e.event_type = 'purchase' AND length(given) > idx))
           FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1
       ), l AS (
           SELECT *, list_transform(range(1, length(given) + 1), lambda i: substr(given, i, 1)) AS g FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1
       )
       SELECT user_id, CAST(run AS BIGINT) AS run, CAST(n_events AS BIGINT) AS n_events, CAST(idx AS BIGINT) AS idx, length(given) > idx AS answered, completed,
              CAST(len(list_filter(range(1, length(given) + 1), lambda i: substr(given, i, 1) = substr('abcdabcdab', i, 1))) AS BIGINT) AS score,
              array_to_string(list_transform(g, lambda x, i: 'q' || (i - 1) || ':' || x), ',') AS answers,
              CASE WHEN kept THEN '{"version":1,"currentQuestionId":"q' || idx || '","answers":{' || array_to_string(list_transform(g, lambda x, i: '"q' || (i - 1) || '":"' || x || '"'), ',')
                                  || '},"completed":' || completed::VARCHAR || '}' END AS stored
       FROM l""",
)
def q45(spark, sf):
    """The quiz's state machine over all events as a stream, run to the end: the state of each user."""
    names = F.create_map(*[F.lit(x) for pair in QUIZ_EVENTS.items() for x in pair])
    k = F.get_json_object("props", "$.k").cast("bigint")
    events = table_stream(spark, f"{sf}/events.parquet").select(
        "user_id", "ts", "event_id", F.try_element_at(names, F.col("event_type")).alias("event"), F.element_at(F.array(*map(F.lit, "abcd")), (k % 4 + 1).cast("int")).alias("option")
    )
    return replay(spark, events, QUIZ)


#: Views and clicks ask, errors and purchases answer within so long; the closing rows let all time pass.
WITHIN, CLOSING = "6 hours", "2 days"


def closed(spark, sf, df: DataFrame) -> DataFrame:
    """The events as a stream, and one event of user -1 long after the last, by which every time before is over."""
    moment = F.to_timestamp(F.concat(F.col("ts").cast("string"), F.lit("Z")))  # the table's times have no zone
    last = table(spark, sf, "events").agg((F.max(moment) + F.expr(f"INTERVAL {CLOSING}")).alias("ts"))
    folder = f"{shared_folder(spark)}/closing-{uuid.uuid4().hex}"
    drop_at_exit(spark, folder)
    end = last.select(F.lit(-1).cast("bigint").alias("event_id"), "ts", F.lit(-1).cast("bigint").alias("user_id"), F.lit(None).cast("string").alias("event_type"))
    end.write.parquet(folder)
    return df.select("event_id", moment.alias("ts"), "user_id", "event_type").unionByName(spark.readStream.schema(end.schema).parquet(folder))


@query(
    "q72_answered_requests",
    f"""SELECT r.event_id AS request, a.event_id AS answer, a.event_type = 'error' AS failed
        FROM events r LEFT JOIN events a ON a.user_id = r.user_id AND a.event_type IN ('error', 'purchase') AND a.ts >= r.ts AND a.ts <= r.ts + INTERVAL {WITHIN}
        WHERE r.event_type IN ('view', 'click')""",
)
def q72(spark, sf):
    """Two halves of the events as streams: requests with the answers that came in time, and those without."""
    rows = closed(spark, sf, table_stream(spark, f"{sf}/events.parquet"))
    requests = rows.filter("event_type IN ('view', 'click') OR user_id < 0").select("user_id", "ts", F.col("event_id").alias("request"))
    answers = rows.filter("event_type IN ('error', 'purchase') OR user_id < 0").select("user_id", "ts", F.col("event_id").alias("answer"), (F.col("event_type") == "error").alias("failed"))
    found = drained(page_log.answered(requests, answers, ["user_id"], WITHIN, "1 hour"))
    return found.filter("user_id >= 0").select("request", "answer", "failed")


@query(
    "q73_failures_by_window",
    """SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, user_id, event_type AS check_name, count(*) AS n FROM events WHERE event_type IN ('error', 'signup') GROUP BY ALL""",
)
def q73(spark, sf):
    """The failures of each user by day of event time, as a stream gives them once a day is over."""
    rows = closed(spark, sf, table_stream(spark, f"{sf}/events.parquet")).filter("event_type IN ('error', 'signup') OR user_id < 0")
    found = drained(page_log.by_window(rows.withColumnRenamed("event_type", "check_name"), ["user_id", "check_name"], "1 day", "1 hour"))
    start = F.to_utc_timestamp("start", F.current_timezone()).cast("timestamp_ntz")
    return found.filter("user_id >= 0").select(start.alias("start"), "user_id", "check_name", "n")


ORIGIN = "https://s.example"
LOG_SQL = f"""
    l AS (
        SELECT event_id, user_id, event_type, CASE user_id % 3 WHEN 0 THEN '{ORIGIN}/p' || user_id WHEN 1 THEN 'https://o.example/' ELSE 'no url' END AS url, user_id % 3 = 0 AS own,
               CAST(floor(value) AS INT) + 380 AS status, event_id % 2 = 0 AS is_error, event_id % 3 < 2 AS near, CASE WHEN event_id % 5 > 0 THEN 'm' || event_id ELSE 'unknown' END AS said FROM events
    )
"""


@query(
    "q74_log_findings",
    f"""WITH {LOG_SQL}, c AS (
            SELECT *, CASE WHEN event_type = 'error' THEN 'page_error' WHEN event_type = 'purchase' AND is_error AND near THEN 'console_error' WHEN event_type = 'click' AND own THEN 'request_failed'
                           WHEN event_type = 'view' AND own AND status >= 400 THEN 'bad_status' END AS check_name FROM l
        )
        SELECT CAST(user_id AS VARCHAR) AS viewport, check_name, CASE check_name WHEN 'request_failed' THEN url || ' (' || said || ')' WHEN 'bad_status' THEN status || ' ' || url ELSE said END AS detail
        FROM c WHERE check_name IS NOT NULL""",
)
def q74(spark, sf):
    """Events as the log of a browser, by kind: the entries that are errors of the page."""
    u, e = F.col("user_id"), F.col("event_id")
    kinds = F.create_map(*[F.lit(x) for pair in {"view": "response", "click": "requestfailed", "error": "pageerror", "purchase": "console"}.items() for x in pair])
    url = F.when(u % 3 == 0, F.concat(F.lit(f"{ORIGIN}/p"), u.cast("string"))).when(u % 3 == 1, "https://o.example/").otherwise("no url")
    log = table(spark, sf, "events").select(
        "ts", u.cast("string").alias("viewport"), F.try_element_at(kinds, F.col("event_type")).alias("kind"), url.alias("url"), (F.floor("value") + 380).cast("int").alias("status"),
        F.when(e % 5 > 0, F.concat(F.lit("m"), e.cast("string"))).alias("message"), F.when(e % 2 == 0, "error").otherwise("log").alias("level"),
        F.when(e % 3 == 1, f"{ORIGIN}/x.js").when(e % 3 == 2, "https://o.example/").alias("location"),
    )
    return logged.log_findings(log, ORIGIN).drop("ts")


@query(
    "q75_page_findings",
    """WITH p AS (
           SELECT o_orderkey AS k, 300 + o_custkey % 1200 AS w, CASE o_custkey % 10 WHEN 0 THEN NULL WHEN 1 THEN 404 ELSE 200 END AS status, o_orderpriority LIKE '5%' AS untitled, o_custkey % 5 AS scroll, o_custkey AS c FROM orders
       ), f AS (
           SELECT k, 'page_not_loaded' AS check_name, coalesce(status::VARCHAR, 'no answer') AS detail FROM p WHERE status IS NULL OR status >= 400
           UNION ALL SELECT k, 'empty_title', '' FROM p WHERE untitled
           UNION ALL SELECT k, 'scrolls_sideways', scroll::VARCHAR FROM p WHERE scroll > 2
           UNION ALL SELECT k, CASE WHEN k % 3 = 0 THEN 'missing_element' ELSE 'hidden_element' END, 'main' FROM p WHERE k % 3 < 2
           UNION ALL SELECT k, 'missing_element', 'footer' FROM p
           UNION ALL SELECT k, 'menu_not_expanded', w::VARCHAR FROM p WHERE w <= 900 AND c % 2 = 0 AND c % 3 = 0
           UNION ALL SELECT k, CASE WHEN c % 7 = 0 THEN 'menu_hidden' ELSE 'menu_outside' END, w::VARCHAR FROM p WHERE w <= 900 AND c % 2 = 0 AND (c % 7 = 0 OR c % 4 > 2)
           UNION ALL SELECT l_orderkey, 'control_outside', l_returnflag || ' x [' || CAST(floor(l_linenumber - 4.5 + 0.5) AS BIGINT) || ', ' || CAST(floor(l_quantity * 20 + 0.5) AS BIGINT) || ']'
                     FROM lineitem JOIN p ON k = l_orderkey WHERE floor(l_linenumber - 4.5 + 0.5) < -2 OR floor(l_quantity * 20 + 0.5) > w + 2
       )
       SELECT CAST(k AS VARCHAR) AS viewport, check_name, detail FROM f""",
)
def q75(spark, sf):
    """Orders as viewports, their lines as controls: what each page lacks."""
    k, c, w = F.col("o_orderkey"), F.col("o_custkey"), 300 + F.col("o_custkey") % 1200
    control = F.struct(F.concat("l_returnflag", F.lit(" \n x ")).alias("label"), (F.col("l_linenumber") - 4.5).cast("double").alias("left"), (F.col("l_quantity") * 20).cast("double").alias("right"))
    controls = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(control).alias("controls"))

    def element(name: str, found, visible):
        return F.struct(F.lit(name).alias("selector"), found.alias("found"), visible.alias("visible"))

    yes = F.lit(True)
    menu = F.struct(
        (c % 2 == 0).alias("button"), yes.alias("nav"), (c % 3 != 0).alias("expanded"), (c % 7 != 0).alias("visible"), F.lit(0.0).alias("left"), (w + c % 4).cast("double").alias("right"),
    )
    pages = table(spark, sf, "orders").join(controls, k == F.col("l_orderkey"), "left").select(
        k.cast("string").alias("viewport"), w.alias("width"), F.when(c % 10 == 1, 404).when(c % 10 != 0, 200).alias("status"), F.when(F.startswith("o_orderpriority", F.lit("5")), " ").otherwise(F.col("o_orderpriority")).alias("title"),
        F.array(element("header", yes, yes), element("main", k % 3 != 0, k % 3 != 1), element("h1", yes, yes), element("footer", F.lit(None).cast("boolean"), yes)).alias("elements"),
        (c % 5).alias("scroll_x"), "controls", menu.alias("menu"),
    )
    return logged.page_findings(pages)


@query(
    "q76_violation_summary",
    """SELECT o_orderkey, o_orderpriority IN ('1-URGENT', '2-HIGH') AS blocks,
              '[{"id":"v' || o_orderkey || '","impact":"' || CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'serious' ELSE 'minor' END || '","help":"h","nodes":[' ||
              string_agg('{"target":["' || l_returnflag || '"],"failureSummary":"s' || l_linenumber || '"}', ',' ORDER BY l_linenumber, l_returnflag) || ']}]' AS summary
       FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority""",
)
def q76(spark, sf):
    """Orders as violations of an accessibility check, their lines as nodes: the summary, and whether it blocks."""
    node = F.struct("l_linenumber", F.array("l_returnflag").alias("target"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("failureSummary"), F.lit("<b>").alias("html"))
    nodes = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    p = F.col("o_orderpriority")
    violation = F.struct(
        F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("id"), F.when(p == "1-URGENT", "critical").when(p == "2-HIGH", "serious").otherwise("minor").alias("impact"),
        F.lit("h").alias("help"), F.lit(None).cast("string").alias("helpUrl"), F.lit("more").alias("description"), "nodes",
    )
    rows = table(spark, sf, "orders").join(nodes, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("vs", F.array(violation))
    return rows.select("o_orderkey", (F.size(logged.blocking(F.col("vs"))) > 0).alias("blocks"), F.to_json(logged.violation_summary(F.col("vs"))).alias("summary"))


@query(
    "q81_place_texts",
    """SELECT l_orderkey, l_linenumber, 'Pregunta ' || l_linenumber || ' de ' || n AS place, CASE WHEN l_linenumber = n THEN 'Ver resultado' ELSE 'Siguiente pregunta' END AS next,
              CASE l_returnflag WHEN 'R' THEN 'Lugares' ELSE l_returnflag END || ' · Dificultad ' || CASE l_linestatus WHEN 'O' THEN 'avanzada' ELSE lower(l_linestatus) END AS caption
       FROM lineitem JOIN (SELECT l_orderkey AS k, max(l_linenumber) AS n FROM lineitem GROUP BY k) ON k = l_orderkey""",
)
def q81(spark, sf):
    """Lines as questions of an order: which it is, what leads on, and its caption."""
    rows = table(spark, sf, "lineitem")
    total = rows.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n"))
    category = F.when(F.col("l_returnflag") == "R", "lugares").otherwise(F.col("l_returnflag"))
    level = F.when(F.col("l_linestatus") == "O", "advanced").otherwise(F.col("l_linestatus"))
    index = F.col("l_linenumber") - 1
    return rows.join(total, "l_orderkey").select(
        "l_orderkey", "l_linenumber", progress.place_text(index, F.col("n")).alias("place"), progress.next_label(index, F.col("n")).alias("next"), progress.caption(category, level).alias("caption")
    )


@query(
    "q82_failures",
    """SELECT CAST(o_orderkey AS VARCHAR) AS viewport, len(e) AS n, array_to_string(e, '|') AS errors FROM (
           SELECT o_orderkey, list_sort(list_concat(list_filter([CASE WHEN o_custkey % 5 > 2 THEN 'scrolls_sideways ' || o_custkey % 5 END, CASE WHEN o_orderpriority LIKE '5%' THEN 'empty_title ' END,
                  CASE o_custkey % 10 WHEN 0 THEN 'page_not_loaded no answer' WHEN 1 THEN 'page_not_loaded 404' END], lambda x: x IS NOT NULL), CASE WHEN o_orderkey % 3 = 0 THEN ['missing_element main'] ELSE [] END)) AS e FROM orders) WHERE len(e) > 0""",
)
def q82(spark, sf):
    """What each viewport failed, rolled up."""
    found = q75(spark, sf).filter("check_name IN ('scrolls_sideways', 'empty_title', 'page_not_loaded') OR (check_name = 'missing_element' AND detail = 'main')")
    rolled = scan.failures(found.select("viewport", F.concat_ws(" ", "check_name", "detail").alias("message")), "viewport")
    return rolled.select("viewport", F.size("errors").cast("bigint").alias("n"), F.array_join("errors", "|").alias("errors"))


@query(
    "q53_first_match",
    """SELECT l_orderkey, coalesce(min(pos) FILTER (WHERE l_returnflag = 'R') - 1, -1) AS idx, arg_min(l_partkey, pos) FILTER (WHERE l_returnflag = 'R') AS l_partkey
       FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos FROM lineitem) GROUP BY l_orderkey""",
)
def q53(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = table(spark, sf, "lineitem").withColumn("pos", F.row_number().over(w).cast("bigint"))
    hit = F.when(F.col("l_returnflag") == "R", F.col("pos"))
    return rows.groupBy("l_orderkey").agg(F.coalesce(F.min(hit) - 1, F.lit(-1)).alias("idx"), F.min_by("l_partkey", hit).alias("l_partkey"))


@query(
    "q54_last_wins_map",
    """SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS question_id, CAST(json_extract(props, '$.k') AS BIGINT) AS last_k
       FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(json_extract(props, '$.k') AS BIGINT) % 10 ORDER BY ts DESC, event_id DESC) = 1""",
)
def q54(spark, sf):
    return asked(spark, sf).groupBy("user_id", "question_id").agg(F.max_by("k", F.struct("ts", "event_id")).alias("last_k"))


@query(
    "q57_thresholds",
    """SELECT event_type, count(*) FILTER (WHERE value >= 40) AS n_failed, count(*) FILTER (WHERE value <= 9) AS n_narrow FROM events GROUP BY event_type""",
)
def q57(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count_if(F.col("value") >= 40).alias("n_failed"), F.count_if(F.col("value") <= 9).alias("n_narrow"))


@query(
    "q40_severity_partition",
    "SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS blocking, count(*) FILTER (WHERE event_type <> 'error') AS advisory FROM events GROUP BY user_id",
)
def q40(spark, sf):
    impact = F.when(F.col("event_type") == "error", "critical").otherwise("minor")
    rows = table(spark, sf, "events").select("user_id", scan.severity(impact).alias("s"))
    return rows.groupBy("user_id").agg(F.count_if(F.col("s") == "blocking").alias("blocking"), F.count_if(F.col("s") == "advisory").alias("advisory"))
