"""Chats, usage metering and keyed writes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fjelldoc.operators import chats, keyed, usage
from fjelldoc.operators.ordered import latest, numbered
from fjelldoc.plans.registry import query
from fjelldoc.sources.tables import Tables, with_tables

SEP = chats.SEPARATOR
NOW_SQL = "TIMESTAMP '2024-05-01'"


def now():
    return F.timestamp_seconds(F.lit(1714521600))


def stamp(col):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def stamp_sql(col):
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"


@query(with_tables("messages") + f"""
  SELECT chat_id, chr(10) || chr(10) || '{SEP}' || chr(10) || 'SAMTALEHISTORIKK (tidligere meldinger i denne samtalen)' || chr(10) || '{SEP}'
    || string_agg(chr(10) || CASE role WHEN 'user' THEN 'Bruker' ELSE 'Assistent' END || ': '
         || CASE WHEN length(content) > 1000 THEN left(content, 1000) || '…' ELSE content END, '' ORDER BY created_at, seq)
    || chr(10) || '{SEP}' || chr(10) || 'Fortsett samtalen fra der den slapp av.' AS history
  FROM (SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY created_at DESC, seq DESC) <= 30) GROUP BY chat_id""")
def chat_history(t: Tables):
    return chats.history_context(t.messages)


@query(with_tables("messages") + """
  SELECT chat_id, seq, chat_id || '-' || ((row_number() OVER (PARTITION BY chat_id ORDER BY created_at, seq) - 1) // 2) AS turn_id FROM messages""")
def message_turn_ids(t: Tables):
    return chats.turn_ids(t.messages).select("chat_id", "seq", "turn_id")


@query(with_tables("events_in") + """
  SELECT chat_id, seq, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) > 900000000 THEN 1 ELSE 0 END) OVER (PARTITION BY chat_id ORDER BY ts, seq)::BIGINT AS session_no
  FROM (SELECT *, lag(ts) OVER (PARTITION BY chat_id ORDER BY ts, seq) AS p FROM events_in)""")
def activity_sessions(t: Tables):
    return chats.activity_sessions(t.events_in).select("chat_id", "seq", "session_no")


@query(with_tables("chats") + f"""
  SELECT user_id, chat_id, title, {stamp_sql('updated_at')} AS updated_at, row_number() OVER (PARTITION BY user_id ORDER BY chats.updated_at DESC, chat_id)::INTEGER AS place FROM chats""")
def recent_chats(t: Tables):
    """Chats of each owner, newest first."""
    newest = Window.partitionBy("user_id").orderBy(F.col("updated_at").desc(), "chat_id")
    placed = t.chats.withColumn("place", F.row_number().over(newest))
    return placed.select("user_id", "chat_id", "title", stamp("updated_at").alias("updated_at"), "place")


@query(with_tables("messages", "chats") + """
  SELECT m.chat_id, m.seq, 'user-' || ((m.chat_id + m.seq // 4) % 7) AS user_id FROM messages m
  WHERE EXISTS (SELECT 1 FROM chats c WHERE c.chat_id = m.chat_id AND c.user_id = 'user-' || ((m.chat_id + m.seq // 4) % 7))""")
def owned_requests(t: Tables):
    claimed = F.concat(F.lit("user-"), ((F.col("chat_id") + F.floor(F.col("seq") / 4)) % 7).cast("string"))
    return chats.owned(t.messages.select("chat_id", "seq", claimed.alias("user_id")), t.chats).select("chat_id", "seq", "user_id")


# -- usage -------------------------------------------------------------------

DEDUP = """
  calls AS (SELECT * FROM events_in WHERE type = 'assistant.usage'
            QUALIFY row_number() OVER (PARTITION BY chat_id, turn_id, coalesce(api_call_id, 'seq' || seq) ORDER BY seq) = 1),
  turns AS (SELECT chat_id, turn_id, coalesce(sum(input_tokens), 0) AS input_tokens, coalesce(sum(output_tokens), 0) AS output_tokens,
                   coalesce(sum(cost), 0) AS premium_requests, coalesce(sum(cache_read_tokens), 0) AS cache_read_tokens,
                   coalesce(sum(cache_write_tokens), 0) AS cache_write_tokens, coalesce(sum(duration), 0) AS duration_ms, coalesce(sum(total_nano_aiu), 0) AS total_nano_aiu, coalesce(arg_max(model, seq) FILTER (model IS NOT NULL), '') AS model,
                   arg_max(cost, seq) FILTER (cost IS NOT NULL) AS model_multiplier
            FROM calls GROUP BY chat_id, turn_id)"""


@query(with_tables("events_in").rstrip() + "," + DEDUP + " SELECT chat_id, turn_id, seq, api_call_id, input_tokens FROM calls")
def distinct_usage_events(t: Tables):
    return usage.distinct_usage(t.events_in).select("chat_id", "turn_id", "seq", "api_call_id", "input_tokens")


@query(with_tables("events_in").rstrip() + "," + DEDUP + " SELECT * FROM turns")
def turn_usage(t: Tables):
    cols = ["chat_id", "turn_id", "input_tokens", "output_tokens", "premium_requests", "cache_read_tokens", "cache_write_tokens", "duration_ms", "total_nano_aiu", "model", "model_multiplier"]
    return usage.turn_usage(t.events_in).select(*cols)


SESSION_SUMS = {"input_tokens": "total_input_tokens", "output_tokens": "total_output_tokens", "cache_read_tokens": "total_cache_read_tokens", "cache_write_tokens": "total_cache_write_tokens", "duration_ms": "total_duration_ms", "total_nano_aiu": "total_nano_aiu"}
SESSION_COLUMNS = ["total_premium_requests", *SESSION_SUMS.values()]
SESSION_TOTALS = with_tables("events_in").rstrip() + "," + DEDUP + f""",
  known AS (SELECT chat_id, max(seq) AS total_seq, arg_max(total_premium_requests, seq) AS known_total FROM events_in
            WHERE total_premium_requests IS NOT NULL GROUP BY chat_id),
  spans AS (SELECT chat_id, turn_id, min(seq) AS first_seq FROM events_in GROUP BY chat_id, turn_id)
  SELECT s.chat_id, coalesce(max(known_total), 0) + coalesce(sum(premium_requests) FILTER (total_seq IS NULL OR first_seq > total_seq), 0) AS total_premium_requests,
         {", ".join(f"coalesce(sum({a}), 0) AS {b}" for a, b in SESSION_SUMS.items())}
  FROM spans s LEFT JOIN turns USING (chat_id, turn_id) LEFT JOIN known k ON k.chat_id = s.chat_id GROUP BY s.chat_id"""


@query(SESSION_TOTALS)
def session_usage(t: Tables):
    return usage.session_usage(t.events_in).select("chat_id", *SESSION_COLUMNS)


@query(with_tables("events_in") + """
  SELECT chat_id, arg_max(current_tokens, seq) FILTER (current_tokens IS NOT NULL) AS current_context_tokens,
         arg_max(token_limit, seq) FILTER (token_limit IS NOT NULL) AS context_token_limit
  FROM events_in WHERE type = 'session.context_changed' GROUP BY chat_id""")
def context_gauge(t: Tables):
    return usage.context_gauge(t.events_in)


QUOTAS = """
  q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'R' THEN 'Premium_requests' WHEN 'A' THEN 'chat' ELSE 'completions' END AS name,
               l_quantity AS used, CASE WHEN l_linenumber > 1 THEN l_quantity * 4 END AS entitled, CASE WHEN l_tax > 0 THEN l_tax * 50 END AS remaining, l_discount < 0.03 AS unlimited,
               CASE WHEN l_linestatus = 'O' THEN round(l_extendedprice) END AS overage, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS reset_date FROM lineitem)"""
_PICKED = """
  SELECT l_orderkey AS snapshot_id, name, CASE WHEN remaining > 1 THEN remaining / 100 ELSE remaining END AS remaining_percentage, used AS used_requests,
         entitled AS entitlement_requests, unlimited AS is_unlimited_entitlement, overage, reset_date, 'authoritative' AS confidence
  FROM {} QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN lower(name) LIKE '%premium%' THEN 0 WHEN NOT unlimited THEN 1 ELSE 2 END, l_linenumber, l_partkey, l_suppkey, used) = 1"""


def quotas(t: Tables):
    """Named quota snapshots, several per order."""
    name = F.when(F.col("l_returnflag") == "R", "Premium_requests").when(F.col("l_returnflag") == "A", "chat").otherwise("completions")
    return t.lineitem.select(
        F.col("l_orderkey").alias("snapshot_id"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("pos"),
        name.alias("name"),
        F.col("l_quantity").alias("used_requests"),
        F.when(F.col("l_linenumber") > 1, F.col("l_quantity") * 4).alias("entitlement_requests"),
        F.when(F.col("l_tax") > 0, F.col("l_tax") * 50).alias("remaining_percentage"),
        (F.col("l_discount") < 0.03).alias("is_unlimited_entitlement"),
        F.when(F.col("l_linestatus") == "O", F.round("l_extendedprice")).alias("overage"),
        F.col("l_shipdate").cast("timestamp").alias("reset_date"),
    )


@query(f"WITH {QUOTAS} {_PICKED.format('q')}")
def monthly_quota(t: Tables):
    return usage.pick_quota(quotas(t))


@query(f"""WITH {QUOTAS}, firsts AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY l_orderkey, name ORDER BY l_linenumber, l_partkey, l_suppkey, used) = 1)
  {_PICKED.format('firsts')}""")
def monthly_quota_of_maps(t: Tables):
    """The same choice from snapshots that arrive as a map from name to quota, in map order."""
    rows = quotas(t)
    fields = [c for c in rows.columns if c not in ("snapshot_id", "pos", "name")]
    first = rows.groupBy("snapshot_id", "name").agg(F.min(F.struct("pos", F.struct(*fields).alias("quota"))).alias("q"))
    entries = F.array_sort(F.collect_list(F.struct("q.pos", "name", "q.quota")))
    maps = first.groupBy("snapshot_id").agg(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["name"], e["quota"]))).alias("quotas"))
    return usage.pick_quota(usage.explode_quotas(maps))


# -- keyed writes ------------------------------------------------------------

STORED = f"""
  stored AS (SELECT chat_id, layer_id, name, CASE WHEN segment = 'FURNITURE' THEN '' ELSE segment END AS shape, visible, geojson,
                    TIMESTAMP '2024-01-01' + key * INTERVAL 1 MINUTE AS created_at, TIMESTAMP '2024-02-01' + key * INTERVAL 1 MINUTE AS updated_at FROM layers)"""
INCOMING = """
  incoming AS (SELECT o_custkey % 25 AS chat_id, 'drawn-' || o_custkey AS layer_id, 'Order ' || o_orderkey AS name, o_orderpriority AS shape,
                      o_orderstatus = 'O' AS visible, '{"type":"Point","coordinates":[' || o_custkey || ',' || o_orderkey || ']}' AS geojson, o_orderkey AS seq FROM orders)"""


def stored_layers(t: Tables):
    return t.layers.select(
        "chat_id", "layer_id", "name", F.when(F.col("segment") == "FURNITURE", "").otherwise(F.col("segment")).alias("shape"), "visible", "geojson",
        F.timestamp_seconds(F.lit(1704067200) + F.col("key") * 60).alias("created_at"),
        F.timestamp_seconds(F.lit(1706745600) + F.col("key") * 60).alias("updated_at"),
    )


def incoming_layers(t: Tables):
    return t.orders.select(
        (F.col("o_custkey") % 25).alias("chat_id"),
        F.concat(F.lit("drawn-"), F.col("o_custkey").cast("string")).alias("layer_id"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("name"),
        F.col("o_orderpriority").alias("shape"),
        (F.col("o_orderstatus") == "O").alias("visible"),
        F.format_string('{"type":"Point","coordinates":[%s,%s]}', F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("geojson"),
        F.col("o_orderkey").alias("seq"),
    )


@query(with_tables("layers").rstrip() + "," + STORED + "," + INCOMING + f""",
  newest AS (SELECT * FROM incoming QUALIFY row_number() OVER (PARTITION BY chat_id, layer_id ORDER BY seq DESC) = 1)
  SELECT coalesce(n.chat_id, s.chat_id) AS chat_id, coalesce(n.layer_id, s.layer_id) AS layer_id,
         CASE WHEN n.seq IS NULL THEN s.name ELSE n.name END AS name, CASE WHEN n.seq IS NULL THEN s.shape ELSE n.shape END AS shape,
         CASE WHEN n.seq IS NULL THEN s.visible ELSE n.visible END AS visible, CASE WHEN n.seq IS NULL THEN s.geojson ELSE n.geojson END AS geojson,
         {stamp_sql('coalesce(s.created_at, ' + NOW_SQL + ')')} AS created_at,
         {stamp_sql('CASE WHEN n.seq IS NULL THEN s.updated_at ELSE ' + NOW_SQL + ' END')} AS updated_at
  FROM stored s FULL JOIN newest n ON s.chat_id = n.chat_id AND s.layer_id = n.layer_id""")
def layer_upsert(t: Tables):
    out = keyed.upsert(stored_layers(t), incoming_layers(t), ["chat_id", "layer_id"], ["seq"], now())
    return out.withColumn("created_at", stamp("created_at")).withColumn("updated_at", stamp("updated_at"))


@query("""
  SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_row_wins(t: Tables):
    return latest(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


@query(with_tables("layers").rstrip() + "," + STORED + """
  SELECT layer_id, CASE WHEN coalesce(layer_id, '') = '' THEN '''layer_id'' is required.' WHEN length(layer_id) > 100 THEN '''layer_id'' exceeds 100 characters.'
    WHEN coalesce(name, '') = '' THEN '''name'' is required.' WHEN length(name) > 200 THEN '''name'' exceeds 200 characters.'
    WHEN coalesce(shape, '') = '' THEN '''shape'' is required.' WHEN length(shape) > 50 THEN '''shape'' exceeds 50 characters.'
    WHEN geojson IS NULL THEN '''geojson'' must be a non-empty object.' END AS error
  FROM (SELECT layer_id, CASE WHEN length(name) % 2 = 0 THEN repeat(name, 12) ELSE name END AS name, shape, geojson FROM stored)""")
def layer_validation(t: Tables):
    longer = F.when(F.length("name") % 2 == 0, F.repeat("name", 12)).otherwise(F.col("name"))
    return keyed.validate_layers(stored_layers(t).withColumn("name", longer)).select("layer_id", "error")


@query(with_tables("layers").rstrip() + "," + STORED + """,
  numbered AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY layer_id) - 1 AS ix FROM stored),
  bad AS (SELECT chat_id, arg_min(CASE WHEN shape = '' THEN '''shape'' is required.' ELSE '''geojson'' must be a non-empty object.' END, ix) AS e, min(ix) AS ix
          FROM numbered WHERE shape = '' OR geojson IS NULL GROUP BY chat_id),
  sizes AS (SELECT chat_id, count(*) AS n FROM stored GROUP BY chat_id)
  SELECT chat_id, CASE WHEN n > 200 THEN 'Too many layers (max 200).' ELSE 'Layer ' || ix || ': ' || e END AS error
  FROM sizes LEFT JOIN bad USING (chat_id) WHERE n > 200 OR e IS NOT NULL""")
def bulk_layer_errors(t: Tables):
    digits = F.regexp_extract("layer_id", "^drawn-([0-9]{1,2})", 1)
    placed = numbered(stored_layers(t), ["chat_id"], F.rpad(digits, 2, " "), [F.col("layer_id")], "ix")
    return keyed.bulk_request_errors(placed.withColumn("ix", F.col("ix") - 1))


PATCHES = """
  patches AS (SELECT s_nationkey::BIGINT AS chat_id, 'drawn-' || (s_suppkey * 3) AS layer_id, s_acctbal > 0 AS visible, s_acctbal > 2000 AS has_visible,
                     CASE WHEN s_acctbal > 6000 THEN '  ' ELSE ' New ' || s_name || ' ' END AS name, s_acctbal > 4000 AS has_name,
                     'Polygon' AS shape, s_acctbal < 0 AS has_shape FROM supplier
              UNION ALL SELECT c_nationkey::BIGINT, 'drawn-' || c_custkey, false, true, 'C ' || c_custkey, c_acctbal > 0, '', c_acctbal > 9000 FROM customer),
  checked AS (SELECT *, CASE WHEN has_name AND trim(name) = '' THEN '''name'' cannot be empty.' WHEN has_shape AND shape = '' THEN '''shape'' cannot be empty.'
                WHEN NOT has_visible AND NOT has_name AND NOT has_shape THEN 'No fields to update.' END AS error FROM patches)"""


def layer_patches(t: Tables):
    s = t.supplier.select(
        F.col("s_nationkey").cast("bigint").alias("chat_id"), F.concat(F.lit("drawn-"), (F.col("s_suppkey") * 3).cast("string")).alias("layer_id"),
        (F.col("s_acctbal") > 0).alias("visible"), (F.col("s_acctbal") > 2000).alias("has_visible"),
        F.when(F.col("s_acctbal") > 6000, "  ").otherwise(F.concat(F.lit(" New "), "s_name", F.lit(" "))).alias("name"),
        (F.col("s_acctbal") > 4000).alias("has_name"), F.lit("Polygon").alias("shape"), (F.col("s_acctbal") < 0).alias("has_shape"),
    )
    c = t.customer.select(
        F.col("c_nationkey").cast("bigint").alias("chat_id"), F.concat(F.lit("drawn-"), F.col("c_custkey").cast("string")).alias("layer_id"),
        F.lit(False).alias("visible"), F.lit(True).alias("has_visible"), F.concat(F.lit("C "), F.col("c_custkey").cast("string")).alias("name"),
        (F.col("c_acctbal") > 0).alias("has_name"), F.lit("").alias("shape"), (F.col("c_acctbal") > 9000).alias("has_shape"),
    )
    return s.unionByName(c)


@query(with_tables("layers").rstrip() + "," + STORED + "," + PATCHES + f"""
  SELECT s.chat_id, s.layer_id, CASE WHEN has_visible THEN p.visible ELSE s.visible END AS visible, CASE WHEN has_name THEN trim(p.name) ELSE s.name END AS name,
         CASE WHEN has_shape THEN p.shape ELSE s.shape END AS shape, {stamp_sql('CASE WHEN p.name IS NULL THEN s.updated_at ELSE ' + NOW_SQL + ' END')} AS updated_at
  FROM stored s LEFT JOIN (SELECT * FROM checked WHERE error IS NULL) p ON s.chat_id = p.chat_id AND s.layer_id = p.layer_id""")
def layer_patch(t: Tables):
    out, _ = keyed.patch_layers(stored_layers(t), layer_patches(t), now())
    return out.select("chat_id", "layer_id", "visible", "name", "shape", stamp("updated_at").alias("updated_at"))


@query(with_tables("layers").rstrip() + "," + STORED + "," + PATCHES + """
  SELECT chat_id, layer_id, error FROM checked WHERE error IS NOT NULL
  UNION ALL SELECT chat_id, layer_id, 'Layer not found.' FROM checked c WHERE error IS NULL
    AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.chat_id = c.chat_id AND s.layer_id = c.layer_id)""")
def layer_patch_rejections(t: Tables):
    return keyed.patch_layers(stored_layers(t), layer_patches(t), now())[1]


GONE = "gone AS (SELECT DISTINCT n_nationkey::BIGINT AS chat_id FROM nation WHERE n_regionkey IN (1, 3))"


@query(with_tables("chats", "layers").rstrip() + f""", {GONE},
  everything AS (SELECT 'parents' AS tbl, chat_id FROM chats UNION ALL SELECT 'messages', chat_id FROM messages UNION ALL SELECT 'layers', chat_id FROM layers)
  SELECT tbl, count(*) AS kept, sum(chat_id)::BIGINT AS id_sum FROM everything WHERE chat_id NOT IN (SELECT chat_id FROM gone) GROUP BY tbl""")
def chat_delete_cascade(t: Tables):
    gone = t.nation.filter(F.col("n_regionkey").isin(1, 3)).select(F.col("n_nationkey").cast("bigint").alias("chat_id"))
    left = keyed.delete_cascade(t.chats, {"messages": t.messages, "layers": t.layers}, gone, "chat_id")
    rows = [df.select(F.lit(name).alias("tbl"), "chat_id") for name, df in left.items()]
    union = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return union.groupBy("tbl").agg(F.count("*").alias("kept"), F.sum("chat_id").alias("id_sum"))


@query(with_tables("chats").rstrip() + f""", {GONE} SELECT chat_id, title FROM chats WHERE chat_id NOT IN (SELECT chat_id FROM gone)""")
def bulk_chat_delete(t: Tables):
    gone = t.nation.filter(F.col("n_regionkey").isin(1, 3)).select(F.col("n_nationkey").cast("bigint").alias("chat_id"))
    return t.chats.join(gone, "chat_id", "left_anti").select("chat_id", "title")


@query(with_tables("chats", "chunks", "docs", "layers") + """
  SELECT 'layers.chat_id' AS fk, chat_id AS key, count(*) AS n FROM layers WHERE chat_id NOT IN (SELECT chat_id FROM chats) GROUP BY chat_id
  UNION ALL SELECT 'chunks.document_id', document_id, count(*) FROM chunks WHERE document_id NOT IN (SELECT id FROM docs) GROUP BY document_id
  UNION ALL SELECT 'lineitem.l_orderkey', l_orderkey, count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM docs) GROUP BY l_orderkey""")
def referential_audit(t: Tables):
    def count(df, fk, key):
        return df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).select(F.lit(fk).alias("fk"), "key", "n")

    return (
        count(keyed.orphans(t.layers, t.chats, "chat_id", "chat_id"), "layers.chat_id", "chat_id")
        .unionByName(count(keyed.orphans(t.chunks, t.docs, "document_id", "id"), "chunks.document_id", "document_id"))
        .unionByName(count(keyed.orphans(t.lineitem, t.docs, "l_orderkey", "id"), "lineitem.l_orderkey", "l_orderkey"))
    )


@query(with_tables("docs", "layers").rstrip() + "," + INCOMING + """
  SELECT chat_id, layer_id, count(*) AS n FROM incoming GROUP BY chat_id, layer_id HAVING count(*) > 1
  UNION ALL SELECT -1, file_hash, count(*) FROM docs GROUP BY file_hash HAVING count(*) > 1""")
def uniqueness_audit(t: Tables):
    pairs = keyed.duplicate_keys(incoming_layers(t), ["chat_id", "layer_id"])
    hashes = keyed.duplicate_keys(t.docs, ["file_hash"]).select(F.lit(-1).cast("bigint").alias("chat_id"), F.col("file_hash").alias("layer_id"), "n")
    return pairs.unionByName(hashes)


@query(with_tables("chats").rstrip() + f""",
  ex AS (SELECT user_id AS chat_id, max(event_id) AS seq, 'Q' || min(event_id) AS message, 'A' || max(event_id) AS reply FROM events GROUP BY user_id)
  SELECT 'message' AS kind, chat_id, seq, role, content, {stamp_sql('created_at')} AS at FROM messages
  UNION ALL SELECT 'message', chat_id, seq, 'user', message, {stamp_sql(NOW_SQL)} FROM ex
  UNION ALL SELECT 'message', chat_id, seq + 1, 'assistant', reply, {stamp_sql(NOW_SQL)} FROM ex
  UNION ALL SELECT 'chat', c.chat_id, -1, NULL, title, {stamp_sql('CASE WHEN ex.chat_id IS NULL THEN updated_at ELSE ' + NOW_SQL + ' END')} FROM chats c LEFT JOIN ex USING (chat_id)""")
def append_messages(t: Tables):
    exchange = t.events.groupBy(F.col("user_id").alias("chat_id")).agg(
        F.max("event_id").alias("seq"),
        F.concat(F.lit("Q"), F.min("event_id").cast("string")).alias("message"),
        F.concat(F.lit("A"), F.max("event_id").cast("string")).alias("reply"),
    )
    messages, touched = keyed.append_exchange(t.messages, t.chats, exchange, now())
    m = messages.select(F.lit("message").alias("kind"), "chat_id", "seq", "role", "content", stamp("created_at").alias("at"))
    c = touched.select(
        F.lit("chat").alias("kind"), "chat_id", F.lit(-1).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("role"),
        F.col("title").alias("content"), stamp("updated_at").alias("at"),
    )
    return m.unionByName(c)


# -- streamed events ---------------------------------------------------------

SSE = r"""
  sse AS (SELECT conv_id * 100 + turn AS message_id, content, seq_final FROM (SELECT conv_id, turn, text AS content, role = 'system' AS seq_final FROM conversations))"""


def sse_lines(t: Tables):
    """Event lines of every message: one thinking line, one delta per sentence, a broken line, sometimes a final message."""
    m = t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("message_id"), "role", "text")
    quoted = lambda c: F.to_json(F.struct(c.alias("content")))
    sentences = F.split("text", r"(?<=\.)")
    deltas = F.flatten(F.transform(sentences, lambda s: F.array(F.lit("event: delta"), F.concat(F.lit("data: "), quoted(s)))))
    lines = F.concat(
        F.array(F.lit("event: thinking"), F.concat(F.lit("data: "), quoted(F.lit("hm ")))),
        deltas,
        F.array(F.lit("data: {broken"), F.concat(F.lit("data: "), quoted(F.lit("lost")))),
        F.when(F.col("role") == "system", F.array(F.lit("event: done"), F.concat(F.lit("data: "), quoted(F.lower("text"))))).otherwise(
            F.array().cast("array<string>")
        ),
    )
    return m.select("message_id", F.posexplode(lines).alias("line_no", "line"))


@query("""SELECT conv_id * 100 + turn AS message_id, 'hm ' AS thinking, CASE WHEN role = 'system' THEN lower(text) ELSE text END AS content FROM conversations""")
def sse_assembly(t: Tables):
    return chats.assemble_messages(chats.parse_sse(sse_lines(t)))


@query(with_tables("layers") + """
  SELECT chat_id, layer_id, name, row_number() OVER (PARTITION BY chat_id ORDER BY key) AS place FROM layers WHERE geojson IS NOT NULL""")
def pending_shapes(t: Tables):
    """Shapes waiting per session in the order they were drawn, one row each."""
    drawn = t.layers.filter(F.col("geojson").isNotNull())
    return numbered(drawn, ["chat_id"], F.floor(F.col("key") / 65536), [F.col("key")], "place").select("chat_id", "layer_id", "name", "place")


@query("""SELECT conv_id * 100 + turn AS message_id, 'hm ' AS thinking, CASE WHEN role = 'system' THEN lower(text) ELSE text END AS content FROM conversations""")
def sse_pieces(t: Tables):
    """The same event lines, sent as pieces of 7 to 29 characters that are cut anywhere, the last line unfinished."""
    lines = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    sent = sse_lines(t).groupBy("message_id").agg(F.concat(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), F.lit("\ndata: {unfinished")).alias("text"))
    size = (F.col("message_id") % 23 + 7).cast("int")
    cut = F.transform(F.sequence(F.lit(1), F.length("text"), size), lambda at: F.substring(F.col("text"), at, size))
    pieces = sent.select("message_id", F.posexplode(cut).alias("piece_no", "text"))
    return chats.assemble_messages(chats.parse_sse(chats.lines_of_pieces(pieces)))
