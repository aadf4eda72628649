"""The parquet tables and the document, chat and map tables derived from them.

Each derived table has a DuckDB twin in `DERIVED_SQL`; `with_tables` assembles the WITH clause.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


HEADING_TOPICS = ("Metode", "Konsekvens", "Bakgrunn", "Usikkerhet", "Landskap")

class Tables:
    """Lazy access to one scale-factor directory."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.path}/{name}.parquet")
        raise AttributeError(name)

    # -- documents ---------------------------------------------------------

    @cached_property
    def docs(self) -> DataFrame:
        """Indexed documents: the title is the first line, the status follows language and size."""
        status = (
            F.when(F.col("n_chars") > 12000, "processing")
            .when(F.col("lang") == "en", "ready")
            .when(F.col("lang") == "fr", "partial")
            .when(F.col("lang") == "de", "failed")
            .otherwise("new")
        )
        minutes = F.col("doc_id") * 60
        return self.documents.select(
            F.col("doc_id").alias("id"),
            F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
            F.col("text").alias("content"),
            F.concat_ws("", "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("source_blob"),
            status.alias("indexing_status"),
            F.timestamp_seconds(F.lit(1704067200) + minutes).alias("last_modified"),
            F.sha2("text", 256).alias("file_hash"),
            F.timestamp_seconds(F.lit(1704067200) + minutes + F.col("n_chars")).alias("updated_at"),
        )

    @cached_property
    def blocks(self) -> DataFrame:
        """Text blocks: one per document line; some lines get a numbered heading in front."""
        lines = self.documents.select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("block_ix", "line"))
        ix = F.col("block_ix")
        topic = F.element_at(F.array(*[F.lit(x) for x in HEADING_TOPICS]), ix % 5 + 1)
        number = F.concat(
            (F.floor(ix / 4) % 9 + 1).cast("string"),
            F.when(ix % 20 == 4, F.concat(F.lit("."), (ix % 3 + 1).cast("string"))).otherwise(F.lit("")),
        )
        heading = F.concat_ws(
            " ", number, topic, F.lit("Alternativ"), (ix % 3).cast("string"), F.concat(F.lit("N0"), (ix % 7).cast("string")), "line"
        )
        return lines.select(
            "doc_id",
            "block_ix",
            F.when((ix % 20).isin(2, 4), heading).otherwise(F.col("line")).alias("text"),
            (F.floor(ix / 8) + 1).cast("int").alias("page"),
            F.when(ix % 11 == 5, F.lit(14.0)).otherwise(F.lit(10.0) + (F.length("line") % 3) * 0.5).alias("font_size"),
            (ix % 13 == 7).alias("is_bold"),
        )

    @cached_property
    def blobs(self) -> DataFrame:
        """Files found in the store: every document file, some of them changed, and one new file per page."""
        known = self.documents.select(
            F.concat_ws("", "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("name"),
            F.timestamp_seconds(
                F.lit(1704067200) + F.col("doc_id") * 60 + F.when(F.col("n_chars") % 5 == 0, 30).otherwise(0)
            ).alias("last_modified"),
            F.when(F.col("n_chars") % 3 == 0, F.md5("text")).otherwise(F.sha2("text", 256)).alias("file_hash"),
        )
        new = self.pages.select(
            F.concat(F.lit("web/"), F.col("page_id").cast("string"), F.lit(".pdf")).alias("name"),
            F.timestamp_seconds(F.lit(1706745600) + F.col("page_id")).alias("last_modified"),
            F.sha2("html", 256).alias("file_hash"),
        )
        return known.unionByName(new)

    @cached_property
    def chunks(self) -> DataFrame:
        """Chunk vectors: ten consecutive vectors belong to one document."""
        return self.embeddings.select(
            F.col("vec_id").alias("chunk_id"),
            F.floor(F.col("vec_id") / 10).alias("document_id"),
            "embedding",
            "label",
        )

    @cached_property
    def queries(self) -> DataFrame:
        """Search texts: every benchmark text, whole."""
        return self.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))

    # -- chats -------------------------------------------------------------

    @cached_property
    def messages(self) -> DataFrame:
        at = F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 47 * (F.col("turn") + 1)
        return self.conversations.select(
            F.col("conv_id").alias("chat_id"),
            F.col("turn").alias("seq"),
            "role",
            F.col("text").alias("content"),
            F.timestamp_seconds(at).alias("created_at"),
        )

    @cached_property
    def chats(self) -> DataFrame:
        """One chat per conversation; seven owners."""
        per = self.messages.groupBy("chat_id").agg(
            F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"), F.min_by("content", "seq").alias("first")
        )
        owner = F.concat(F.lit("user-"), (F.col("chat_id") % 7).cast("string"))
        return per.select("chat_id", owner.alias("user_id"), F.split_part("first", F.lit("\n"), F.lit(1)).alias("title"), "created_at", "updated_at")

    @cached_property
    def events_in(self) -> DataFrame:
        """Usage events: the chat is the user, the turn is the day, the call id is `props.k`."""
        kind = (
            F.when(F.col("event_type") == "purchase", "session.usage_info")
            .when(F.col("event_type") == "signup", "session.context_changed")
            .otherwise("assistant.usage")
        )
        k = F.get_json_object("props", "$.k").cast("bigint")
        usage = kind == "assistant.usage"
        return self.events.select(
            F.col("user_id").alias("chat_id"),
            F.date_format("ts", "yyyy-MM-dd").alias("turn_id"),
            F.col("event_id").alias("seq"),
            F.col("ts").cast("timestamp").alias("ts"),
            kind.alias("type"),
            F.when(usage & (k >= 5), F.concat(F.lit("call-"), k.cast("string"))).alias("api_call_id"),
            F.when(usage & (k >= 20), F.concat(F.lit("model-"), F.col("event_type"))).alias("model"),
            F.when(usage & (k != 7), F.round(F.col("value") * 100)).alias("input_tokens"),
            F.when(usage, F.round(F.col("value") * 10)).alias("output_tokens"),
            F.when(usage & (F.col("event_type") == "view"), k.cast("double")).alias("cost"),
            F.when(usage & (k % 4 == 0), F.round(F.col("value") * 3)).alias("cache_read_tokens"),
            F.when(usage & (k % 4 == 1), F.round(F.col("value") * 2)).alias("cache_write_tokens"),
            F.when(usage, F.round(F.col("value") * 50)).alias("duration"),
            F.when(usage & (k % 3 == 0), k * 1000.0).alias("total_nano_aiu"),
            F.when(F.col("event_type") == "purchase", F.round(F.col("value"))).alias("total_premium_requests"),
            F.when(F.col("event_type") == "signup", F.round(F.col("value") * 1000)).alias("current_tokens"),
            F.when((F.col("event_type") == "signup") & (k > 50), F.lit(128000.0)).alias("token_limit"),
        )

    # -- map ---------------------------------------------------------------

    @cached_property
    def points(self) -> DataFrame:
        """One longitude/latitude per customer, inside 5-29 E and 58-70 N."""
        return self.customer.select(
            F.col("c_custkey").alias("point_id"),
            (F.lit(5.0) + (F.col("c_custkey") * 7919 % 24000) / 1000.0).alias("lon"),
            (F.lit(58.0) + (F.col("c_custkey") * 104729 % 12000) / 1000.0).alias("lat"),
        )

    @cached_property
    def sites(self) -> DataFrame:
        """Cultural sites: a rectangle of a quarter degree each way around every supplier point."""
        return self.supplier.select(
            F.col("s_suppkey").alias("site_id"),
            F.col("s_name").alias("name"),
            (F.lit(5.0) + (F.col("s_suppkey") * 7919 % 24000) / 1000.0).alias("lon"),
            (F.lit(58.0) + (F.col("s_suppkey") * 104729 % 12000) / 1000.0).alias("lat"),
        )

    @cached_property
    def layers(self) -> DataFrame:
        """Drawn layers, one per customer: points, lines, polygons and collections as GeoJSON text."""
        p = self.customer.select(
            F.col("c_nationkey").cast("bigint").alias("chat_id"),
            F.concat(F.lit("drawn-"), F.col("c_custkey").cast("string")).alias("layer_id"),
            F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("segment"),
            (F.col("c_acctbal") > 0).alias("visible"),
            (F.lit(5.0) + (F.col("c_custkey") * 7919 % 24000) / 1000.0).alias("lon"),
            (F.lit(58.0) + (F.col("c_custkey") * 104729 % 12000) / 1000.0).alias("lat"),
            F.col("c_custkey").alias("key"),
        )
        x0, y0 = F.format_string("%.3f", F.col("lon")), F.format_string("%.3f", F.col("lat"))
        x1, y1 = F.format_string("%.3f", F.col("lon") + 0.02), F.format_string("%.3f", F.col("lat") + 0.01)
        pt = F.format_string('{"type":"Point","coordinates":[%s,%s]}', x0, y0)
        line = F.format_string('{"type":"LineString","coordinates":[[%s,%s],[%s,%s]]}', x0, y0, x1, y1)
        poly = F.format_string(
            '{"type":"Polygon","coordinates":[[[%s,%s],[%s,%s],[%s,%s],[%s,%s],[%s,%s]]]}',
            x0, y0, x1, y0, x1, y1, x0, y1, x0, y0,
        )
        feature = F.format_string('{"type":"Feature","id":"f%s","properties":{"kind":"line"},"geometry":%s}',
                                  F.col("key").cast("string"), line)
        bare = F.format_string('{"type":"Feature","properties":{},"geometry":%s}', poly)
        geo = (
            F.when(F.col("segment") == "BUILDING", pt)
            .when(F.col("segment") == "AUTOMOBILE", feature)
            .when(F.col("segment") == "MACHINERY", poly)
            .when(F.col("segment") == "HOUSEHOLD",
                  F.format_string('{"type":"FeatureCollection","features":[%s,%s]}', feature, bare))
        )
        return p.select("chat_id", "layer_id", "name", "segment", "visible", "lon", "lat", "key", geo.alias("geojson"))


# DuckDB twins -------------------------------------------------------------

_LON = "5e0 + ({k} * 7919 % 24000) / 1000e0"
_LAT = "58e0 + ({k} * 104729 % 12000) / 1000e0"

DERIVED_SQL: dict[str, str] = {
    "docs": """
        SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, text AS content,
               source || '/' || doc_id || '.pdf' AS source_blob,
               CASE WHEN n_chars > 12000 THEN 'processing' WHEN lang = 'en' THEN 'ready'
                    WHEN lang = 'fr' THEN 'partial' WHEN lang = 'de' THEN 'failed' ELSE 'new' END AS indexing_status,
               TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE AS last_modified,
               sha256(text) AS file_hash,
               TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE + n_chars * INTERVAL 1 SECOND AS updated_at
        FROM documents""",
    "block_lines": "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ix FROM documents",
    "blocks": """
        SELECT doc_id, ix::INTEGER AS block_ix,
          CASE WHEN ix % 20 IN (2, 4) THEN (ix // 4 % 9 + 1) || CASE WHEN ix % 20 = 4 THEN '.' || (ix % 3 + 1) ELSE '' END || ' '
            || ['Metode', 'Konsekvens', 'Bakgrunn', 'Usikkerhet', 'Landskap'][ix % 5 + 1] || ' Alternativ ' || (ix % 3) || ' N0' || (ix % 7) || ' ' || line
            ELSE line END AS text,
          (ix // 8 + 1)::INTEGER AS page, CASE WHEN ix % 11 = 5 THEN 14e0 ELSE 10e0 + length(line) % 3 * 0.5e0 END AS font_size, ix % 13 = 7 AS is_bold
        FROM block_lines""",
    "blobs": """
        SELECT source || '/' || doc_id || '.pdf' AS name,
               TIMESTAMP '2024-01-01' + (doc_id * 60 + CASE WHEN n_chars % 5 = 0 THEN 30 ELSE 0 END) * INTERVAL 1 SECOND AS last_modified,
               CASE WHEN n_chars % 3 = 0 THEN md5(text) ELSE sha256(text) END AS file_hash FROM documents
        UNION ALL
        SELECT 'web/' || page_id || '.pdf', TIMESTAMP '2024-02-01' + page_id * INTERVAL 1 SECOND, sha256(html) FROM pages""",
    "chats": """
        SELECT chat_id, 'user-' || (chat_id % 7) AS user_id, split_part(arg_min(content, seq), chr(10), 1) AS title,
               min(created_at) AS created_at, max(created_at) AS updated_at FROM messages GROUP BY chat_id""",
    "chunks": "SELECT vec_id AS chunk_id, vec_id // 10 AS document_id, embedding, label FROM embeddings",
    "queries": "SELECT item_id AS query_id, text AS query FROM benchmark",
    "messages": """
        SELECT conv_id AS chat_id, turn AS seq, role, text AS content,
               TIMESTAMP '2024-01-01' + (conv_id * 3600 + turn * 47 * (turn + 1)) * INTERVAL 1 SECOND AS created_at
        FROM conversations""",
    "events_in": """
        SELECT user_id AS chat_id, strftime(ts, '%Y-%m-%d') AS turn_id, event_id AS seq, ts,
               CASE event_type WHEN 'purchase' THEN 'session.usage_info' WHEN 'signup' THEN 'session.context_changed'
                    ELSE 'assistant.usage' END AS type,
               CASE WHEN u AND k >= 5 THEN 'call-' || k END AS api_call_id,
               CASE WHEN u AND k >= 20 THEN 'model-' || event_type END AS model,
               CASE WHEN u AND k <> 7 THEN round(value * 100) END AS input_tokens,
               CASE WHEN u THEN round(value * 10) END AS output_tokens,
               CASE WHEN event_type = 'view' THEN k::DOUBLE END AS cost,
               CASE WHEN u AND k % 4 = 0 THEN round(value * 3) END AS cache_read_tokens, CASE WHEN u AND k % 4 = 1 THEN round(value * 2) END AS cache_write_tokens,
               CASE WHEN u THEN round(value * 50) END AS duration, CASE WHEN u AND k % 3 = 0 THEN k * 1000e0 END AS total_nano_aiu,
               CASE WHEN event_type = 'purchase' THEN round(value) END AS total_premium_requests,
               CASE WHEN event_type = 'signup' THEN round(value * 1000) END AS current_tokens,
               CASE WHEN event_type = 'signup' AND k > 50 THEN 128000e0 END AS token_limit
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
                     event_type NOT IN ('purchase', 'signup') AS u FROM events)""",
    "points": f"SELECT c_custkey AS point_id, {_LON.format(k='c_custkey')} AS lon, {_LAT.format(k='c_custkey')} AS lat FROM customer",
    "sites": f"SELECT s_suppkey AS site_id, s_name AS name, {_LON.format(k='s_suppkey')} AS lon, {_LAT.format(k='s_suppkey')} AS lat FROM supplier",
    "layer_coords": f"""
        SELECT *, printf('%.3f', lon) AS x0, printf('%.3f', lat) AS y0,
               printf('%.3f', lon + 0.02e0) AS x1, printf('%.3f', lat + 0.01e0) AS y1
        FROM (SELECT c_nationkey::BIGINT AS chat_id, 'drawn-' || c_custkey AS layer_id, c_name AS name,
                     c_mktsegment AS segment, c_acctbal > 0 AS visible, c_custkey AS key,
                     {_LON.format(k='c_custkey')} AS lon, {_LAT.format(k='c_custkey')} AS lat FROM customer)""",
    "layer_geo": """
        SELECT *, '{"type":"Point","coordinates":[' || x0 || ',' || y0 || ']}' AS pt,
          '{"type":"Feature","id":"f' || key || '","properties":{"kind":"line"},"geometry":{"type":"LineString","coordinates":[['
            || x0 || ',' || y0 || '],[' || x1 || ',' || y1 || ']]}}' AS feature,
          '{"type":"Polygon","coordinates":[[[' || x0 || ',' || y0 || '],[' || x1 || ',' || y0 || '],[' || x1 || ',' || y1
            || '],[' || x0 || ',' || y1 || '],[' || x0 || ',' || y0 || ']]]}' AS poly
        FROM layer_coords""",
    "layers": """
        SELECT chat_id, layer_id, name, segment, visible, lon, lat, key,
          CASE segment WHEN 'BUILDING' THEN pt WHEN 'AUTOMOBILE' THEN feature WHEN 'MACHINERY' THEN poly
            WHEN 'HOUSEHOLD' THEN '{"type":"FeatureCollection","features":[' || feature
              || ',{"type":"Feature","properties":{},"geometry":' || poly || '}]}' END AS geojson
        FROM layer_geo""",
}

_NEEDS = {"layer_geo": ["layer_coords"], "layers": ["layer_geo"], "chats": ["messages"], "blocks": ["block_lines"]}


def with_tables(*names: str, body: str = "") -> str:
    """`WITH` clause defining the derived tables (and what they need), followed by `body`."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in _NEEDS.get(name, []):
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    clauses = ",\n".join(f"{n} AS ({DERIVED_SQL[n].strip()})" for n in ordered)
    return f"WITH {clauses}\n{body}"
