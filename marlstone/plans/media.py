"""Speech, captions, geography, protocols, renderings and byte formats."""

from __future__ import annotations

import io
import struct
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions import codecs as C
from marlstone.functions import protocols as P
from marlstone.functions import render as V
from marlstone.functions.spatial import bbox_around, haversine_km, in_box
from marlstone.functions.udf import batch_udf
from marlstone.operators import extract as E
from marlstone.plans.registry import Registry, table
from marlstone.sources import adapters as A

HERE = Registry()

SEGMENTS = "seg AS (SELECT user_id AS media, event_id AS seg, (epoch_ms(ts) / 1000.0 - 1704067200)::DOUBLE AS \"start\", (epoch_ms(ts) / 1000.0 - 1704067200 + 600)::DOUBLE AS \"end\" FROM events WHERE event_id % 2 = 0), spk AS (SELECT user_id AS media, event_id AS ord, (epoch_ms(ts) / 1000.0 - 1704067200)::DOUBLE AS \"start\", (epoch_ms(ts) / 1000.0 - 1704067200 + 3600)::DOUBLE AS \"end\", event_type AS speaker FROM events WHERE event_id % 2 = 1)"


def spans(spark, d, odd: bool, length: float):
    at = F.unix_millis(F.col("ts").cast("timestamp")) / 1000.0 - 1704067200
    e = table(spark, d, "events").filter(F.col("event_id") % 2 == int(odd))
    return e.select(F.col("user_id").alias("media"), F.col("event_id"), at.alias("start"), (at + length).alias("end"), "event_type")


@HERE.add(
    f"""WITH {SEGMENTS}, o AS (SELECT s.media, s.seg, k.speaker, sum(least(s."end", k."end") - greatest(s."start", k."start")) AS v, min(k.ord) AS f FROM seg s JOIN spk k ON s.media = k.media AND s."start" < k."end" AND k."start" < s."end" GROUP BY 1, 2, 3),
b AS (SELECT media, seg, arg_max(speaker, v * 1e7 - f / 1e6) AS speaker FROM o GROUP BY 1, 2) SELECT s.media, s.seg, coalesce(b.speaker, 'UNKNOWN') AS speaker FROM seg s LEFT JOIN b USING (media, seg)"""
)
def align_speakers(spark, d):
    segments = spans(spark, d, False, 600.0).withColumnRenamed("event_id", "seg")
    speakers = spans(spark, d, True, 3600.0).withColumnRenamed("event_id", "ord").withColumnRenamed("event_type", "speaker")
    return E.align_speakers(segments, speakers, 3600.0).select("media", "seg", "speaker")


@HERE.add("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Ann' ELSE o_orderpriority END AS speaker FROM orders")
def relabel_speakers(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("speaker"))
    return E.relabel_speakers(o, spark.createDataFrame([("1-URGENT", "Ann")], "speaker string, name string")).select("o_orderkey", "speaker")


def captions(line):
    s = F.struct(F.col("l_linenumber").alias("n"), (F.col("l_linenumber") * 700.25).alias("start"), (F.col("l_linenumber") * 700.25 + 1.5).alias("end"), F.col("l_linestatus").alias("text"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).alias("speaker"))
    return line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(s)).alias("s"))


CLOCK = "lpad((floor(x)::BIGINT // 3600)::VARCHAR, 2, '0') || ':' || lpad((floor(x)::BIGINT % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((floor(x)::BIGINT % 60)::VARCHAR, 2, '0') || '@' || lpad(floor((x - floor(x)) * 1000)::BIGINT::VARCHAR, 3, '0')"
AT = lambda x, mark: CLOCK.replace("x", x).replace("@", mark)
CUES = f"WITH c AS (SELECT l_orderkey, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_linestatus, l_returnflag) AS i, l_linenumber * 700.25::DOUBLE AS a, l_linenumber * 700.25::DOUBLE + 1.5 AS b, l_linestatus AS t, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS sp FROM lineitem)"


TEXTS = (
    f"{CUES} SELECT l_orderkey, 'WEBVTT' || chr(10) || chr(10) || string_agg(i || chr(10) || {AT('a', '.')} || ' --> ' || {AT('b', '.')} || chr(10) || CASE WHEN sp IS NULL THEN t ELSE '<v ' || sp || '>' || t || '</v>' END || chr(10) || chr(10), '' ORDER BY i) AS vtt, string_agg(i || chr(10) || {AT('a', ',')} || ' --> ' || {AT('b', ',')} || chr(10) || coalesce(sp || ': ', '') || t || chr(10) || chr(10), '' ORDER BY i) AS srt, coalesce(string_agg('SPEAKER audio 1 ' || printf('%.3f', a) || ' ' || printf('%.3f', b - a) || ' <NA> <NA> ' || sp || ' <NA> <NA>' || chr(10), '' ORDER BY i) FILTER (sp IS NOT NULL), '') AS rttm FROM c GROUP BY l_orderkey"
)


def rendered(line):
    s = F.col("s")
    return captions(line).select("l_orderkey", V.render_vtt(s).alias("vtt"), V.render_srt(s).alias("srt"), V.render_rttm(s).alias("rttm"))


@HERE.add(TEXTS)
def captions_text(spark, d):
    return rendered(table(spark, d, "lineitem"))


@HERE.add(
    f"""WITH g AS (SELECT n_nationkey AS k, 4 AS c, 2 AS r, 160 AS w, 90 AS h, 10.5::DOUBLE AS iv, n_nationkey * 7.0::DOUBLE AS total FROM nation), q AS (SELECT k, c, w, h, iv, total, unnest(range(0, least(ceil(total / iv)::INT, c * r))) AS i FROM g),
t AS (SELECT k, string_agg((i + 1) || chr(10) || {AT('(i * iv)', '.')} || ' --> ' || {AT('least(i * iv + iv, total)', '.')} || chr(10) || 's.jpg#xywh=' || (i % c * w) || ',' || (i // c * h) || ',' || w || ',' || h || chr(10), chr(10) ORDER BY i) AS cues FROM q GROUP BY k)
SELECT n_nationkey, 'WEBVTT' || chr(10) || coalesce(chr(10) || cues, '') AS vtt FROM nation LEFT JOIN t ON k = n_nationkey"""
)
def sprite_vtt(spark, d):
    n = F.lit
    return table(spark, d, "nation").select("n_nationkey", V.render_sprite_vtt(n(4), n(2), n(160), n(90), n("s.jpg"), n(10.5), F.col("n_nationkey") * 7.0).alias("vtt"))


HAV = "2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))))"
PLACES = "p AS (SELECT n_nationkey AS k, (n_nationkey * 7 % 120 - 60)::DOUBLE AS lat, (n_nationkey * 13 % 300 - 150)::DOUBLE AS lng FROM nation)"


def places(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(k.alias("k"), (k * 7 % 120 - 60).cast("double").alias("lat"), (k * 13 % 300 - 150).cast("double").alias("lng"))


@HERE.add(f"WITH {PLACES} SELECT a.k AS a, b.k AS b, {HAV} AS km FROM p a JOIN p b ON b.k = a.k + 1", floats=("km",))
def haversine(spark, d):
    a = places(spark, d)
    b = places(spark, d).select(F.col("k").alias("b"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))
    return a.join(b, F.col("b") == F.col("k") + 1).select(F.col("k").alias("a"), "b", haversine_km(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2")).alias("km"))


@HERE.add(f"WITH {PLACES}, b AS (SELECT k, lat, lng, lat - 500 / 111.0 AS x0, lat + 500 / 111.0 AS x1, lng - 500 / (111.0 * cos(radians(lat))) AS y0, lng + 500 / (111.0 * cos(radians(lat))) AS y1 FROM p) SELECT k, x0 AS min_lat, y1 AS max_lng, lat + 2 BETWEEN x0 AND x1 AND lng - 4 BETWEEN y0 AND y1 AS inside FROM b", floats=("min_lat", "max_lng"))
def bbox(spark, d):
    lat, lng = F.col("lat"), F.col("lng")
    box = bbox_around(lat, lng, F.lit(500.0))
    return places(spark, d).select("k", box["min_lat"].alias("min_lat"), box["max_lng"].alias("max_lng"), in_box(lat + 2, lng - 4, box).alias("inside"))


@HERE.add("WITH c AS (SELECT l_orderkey AS upload, l_linenumber AS seq, l_quantity::BIGINT AS size, 100::BIGINT AS length FROM lineitem), e AS (SELECT *, sum(size) OVER (PARTITION BY upload ORDER BY seq) AS sent FROM c) SELECT upload, seq, coalesce(max(sent) FILTER (sent <= length) OVER (PARTITION BY upload ORDER BY seq), 0)::BIGINT AS \"end\", CASE WHEN sent <= length THEN 204 ELSE 409 END AS status, sent = length AS complete FROM e")
def upload_fold(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("upload"), F.col("l_linenumber").alias("seq"), F.col("l_quantity").cast("long").alias("size"), F.lit(100).cast("long").alias("length"))
    return P.fold_uploads(c).select("upload", "seq", "end", "status", "complete")


@HERE.add("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber * 10 = 30 AND 30 + l_quantity <= 60 THEN 204 ELSE 409 END AS status, CASE WHEN l_linenumber * 10 = 30 AND 30 + l_quantity <= 60 THEN 30 + l_quantity::BIGINT ELSE 30 END AS new_offset, l_linenumber * 10 = 30 AND 30 + l_quantity = 60 AS complete, '/uploads/' || l_orderkey AS location FROM lineitem")
def upload_patch(spark, d):
    r = P.upload_patched(F.lit(30).cast("long"), F.col("l_linenumber") * 10, F.col("l_quantity").cast("long"), F.lit(60))
    made = P.upload_created(F.col("l_orderkey").cast("string"))["headers"]["Location"]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r["status"].alias("status"), r["new_offset"].alias("new_offset"), r["complete"].alias("complete"), made.alias("location"))


@HERE.add("""WITH r AS (SELECT l_orderkey, l_linenumber, l_linenumber * 100 AS a, l_linenumber * 100 + l_quantity::BIGINT * 10 - 50 AS b, l_partkey % 4 AS k FROM lineitem), p AS (SELECT *, CASE k WHEN 2 THEN greatest(0, 600 - a) ELSE a END AS s, CASE k WHEN 0 THEN least(b, 599) WHEN 3 THEN NULL ELSE 599 END AS e FROM r)
SELECT l_orderkey, l_linenumber, CASE WHEN k = 3 THEN NULL WHEN k <> 2 AND (a >= 600 OR (k = 0 AND a > b)) THEN 'unsatisfiable' ELSE 'ok' END AS status, CASE WHEN status = 'ok' THEN s END::BIGINT AS "start", CASE WHEN status = 'ok' THEN e END::BIGINT AS "end", CASE WHEN status = 'ok' THEN 'bytes ' || s || '-' || e || '/600' END AS header FROM p""")
def range_parse(spark, d):
    """Headers of four forms, made of the lines' numbers."""
    a = (F.col("l_linenumber") * 100).cast("string")
    b = (F.col("l_linenumber") * 100 + F.col("l_quantity").cast("long") * 10 - 50).cast("string")
    head = F.element_at(F.array(F.concat(F.lit("bytes="), a, F.lit("-"), b), F.concat(F.lit("bytes="), a, F.lit("-")), F.concat(F.lit("bytes=-"), a), F.concat(F.lit("items="), a, F.lit("-"), b)), (F.col("l_partkey") % 4 + 1).cast("int"))
    r = P.parse_range(head, F.lit(600).cast("long"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r.alias("r")).select("l_orderkey", "l_linenumber", "r.status", "r.start", "r.end", P.content_range(F.col("r.start"), F.col("r.end"), F.lit(600)).alias("header"))


@HERE.add("SELECT c_custkey, c_name AS name, '' AS flag FROM customer")
def upload_meta(spark, d):
    header = F.concat(F.lit("filename "), P.b64(F.col("c_name").cast("binary")), F.lit(", flag"))
    m = P.upload_metadata(header)
    return table(spark, d, "customer").select("c_custkey", m["filename"].alias("name"), m["flag"].alias("flag"))


@HERE.add("SELECT c_custkey, c_custkey % 3 < 2 AS good FROM customer")
def checksums(spark, d):
    raw = F.col("c_name").cast("binary")
    said = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("sha256 "), P.b64(F.unhex(F.sha2(raw, 256))))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("sha1 "), P.b64(F.unhex(F.sha1(raw))))).otherwise(F.concat(F.lit("md5 "), P.b64(F.unhex(F.md5(raw)))))
    return table(spark, d, "customer").select("c_custkey", P.verify_checksum(said, raw).alias("good"))


INNER, OUTER = ("".join(f"{b ^ pad:02X}" for b in b"secret".ljust(64, b"\0")) for pad in (0x36, 0x5C))


@HERE.add(f"SELECT c_custkey, 'sha256=' || sha256(unhex('{OUTER}') || unhex(sha256(unhex('{INNER}') || encode(c_name)))) AS signature FROM customer")
def webhook_signatures(spark, d):
    return table(spark, d, "customer").select("c_custkey", P.sign_webhook(F.lit("secret"), F.col("c_name")).alias("signature"))


@HERE.add("SELECT c_custkey, true AS magic, c_name AS pub, c_name AS dek, c_custkey::VARCHAR AS tail, 'bad magic' AS wrong, 'truncated header body' AS short FROM customer")
def envelopes(spark, d):
    name = F.col("c_name")
    head = F.to_json(F.struct(F.lit(1).alias("version"), name.alias("ephemeralPub"), F.array(F.struct(F.lit("mm:1").alias("address"), name.alias("encryptedDek"), F.lit("n").alias("nonce"))).alias("recipients")))
    data = P.build_envelope(head, F.col("c_custkey").cast("string").cast("binary"))
    p = P.parse_envelope(F.col("data"))
    rows = table(spark, d, "customer").select("c_custkey", data.alias("data"))
    return rows.select("c_custkey", P.is_envelope(F.col("data")).alias("magic"), p["header"]["ephemeralPub"].alias("pub"), P.recipient_for(p["header"], F.lit("mm:1"))["encryptedDek"].alias("dek"), p["ciphertext"].cast("string").alias("tail"), P.parse_envelope(F.lit(b"not an envelope"))["error"].alias("wrong"), P.parse_envelope(F.substring("data", 1, 20))["error"].alias("short"))


@HERE.add("SELECT n_nationkey, '| name | note |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n_name || ' | a\\|b' || chr(10) || 'x |  |' AS text, '3' AS rows FROM nation")
def csv_markdown(spark, d):
    data = F.concat(F.lit("name,note\r\n"), "n_name", F.lit(',"a|b"\nx'))
    files = table(spark, d, "nation").select("n_nationkey", F.lit("f.csv").alias("filename"), F.lit("text/csv").alias("mime"), data.cast("binary").alias("bytes"))
    return A.extract(files).select("n_nationkey", "text", F.col("metadata")["rowCount"].alias("rows"))


@HERE.add("SELECT doc_id, '<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || chr(10) || '<metadata xmlns:dc=\"http://purl.org/dc/elements/1.1/\">' || chr(10) || '  <dc:identifier>' || doc_id || '</dc:identifier>' || chr(10) || '  <dc:title>a &amp; &lt;b&gt;</dc:title>' || chr(10) || '  <dc:source>' || source || '</dc:source>' || chr(10) || '  <dc:language>' || lang || '</dc:language>' || chr(10) || '  <dc:language>en</dc:language>' || chr(10) || '</metadata>' AS xml FROM documents")
def dublin_core(spark, d):
    record = {"identifier": F.array(F.col("doc_id").cast("string")), "title": F.array(F.lit("a & <b>")), "source": F.array("source"), "language": F.array(F.col("lang"), F.lit("en")), "rights": F.lit(None).cast("array<string>")}
    return table(spark, d, "documents").select("doc_id", V.render_dc_xml(record).alias("xml"))


@HERE.add("""SELECT doc_id, '{"@context":{"schema":"http://schema.org/","dct":"http://purl.org/dc/terms/"},"@id":"' || doc_id || '","@type":"schema:CreativeWork","schema:isBasedOn":"' || source || '","schema:inLanguage":"' || lang || '"}' AS json FROM documents""")
def json_ld(spark, d):
    record = {"identifier": F.col("doc_id").cast("string"), "source": F.col("source"), "language": F.col("lang"), "title": F.lit(None).cast("string")}
    return table(spark, d, "documents").select("doc_id", V.to_json_ld(record, ["schema", "dct"]).alias("json"))


@HERE.add("""SELECT event_id, 'event: ' || event_type || chr(10) || 'data: {"type":"' || event_type || '","id":' || event_id || '}' || chr(10) || chr(10) AS frame FROM events""")
def sse_frames(spark, d):
    return table(spark, d, "events").select("event_id", V.to_sse(F.col("event_type"), F.struct(F.col("event_type").alias("type"), F.col("event_id").alias("id"))).alias("frame"))


@HERE.add(
    "WITH e AS (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY length(n_name) DESC, n_nationkey) AS i FROM nation) SELECT n_regionkey, 'Name it.' || chr(10) || string_agg('Input: ' || n_name || chr(10) || 'Output: ' || length(n_name) || chr(10) || chr(10), '' ORDER BY i) || 'Input: q' || chr(10) || 'Output:' AS prompt FROM e WHERE i <= 3 GROUP BY 1"
)
def few_shot(spark, d):
    """The best three examples of a region are cut out before they are gathered."""
    size = F.char_length("n_name").cast("double")
    place = F.row_number().over(Window.partitionBy("n_regionkey").orderBy(F.desc("score"), "n_nationkey"))
    best = table(spark, d, "nation").withColumn("score", size).withColumn("place", place).filter("place <= 3")
    e = F.struct("score", F.col("n_nationkey").alias("ord"), F.col("n_name").alias("input"), F.lit(None).cast("string").alias("reasoning"), F.char_length("n_name").cast("string").alias("output"))
    return best.groupBy("n_regionkey").agg(V.few_shot_prompt(F.lit("q"), F.collect_list(e), F.lit("Name it."), 3).alias("prompt"))


@HERE.add()
def addresses(spark, d):
    key = F.unhex(F.sha2(F.col("c_name").cast("binary"), 256))
    coded = table(spark, d, "customer").select("c_custkey", C.encode_address(key).alias("address"))
    back = C.decode_address(F.col("address"))
    return coded.select("c_custkey", "address", back["version"].alias("version"), back["error"].alias("error"))


@HERE.add("SELECT c_custkey, true AS same, 1 AS version, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'missing prefix' ELSE 'wrong length' END AS error FROM customer")
def address_checks(spark, d):
    """Two keys have one address only if they are equal; a third of the addresses are without prefix, a third too long."""
    key = F.unhex(F.sha2(F.col("c_name").cast("binary"), 256))
    coded = table(spark, d, "customer").select("c_custkey", C.encode_address(key).alias("address"), C.encode_address(F.unhex(F.hex(key))).alias("again"))
    good, spoilt = C.decode_address(F.col("address")), F.when(F.col("c_custkey") % 3 == 1, F.substring_index("address", ":", -1)).when(F.col("c_custkey") % 3 == 2, F.concat("address", F.lit("11"))).otherwise(F.col("address"))
    return coded.select("c_custkey", (F.col("address") == F.col("again")).alias("same"), good["version"].cast("int").alias("version"), C.decode_address(spoilt)["error"].alias("error"))


@HERE.add()
def mock_vectors(spark, d):
    return table(spark, d, "nation").select("n_nationkey", C.mock_embed(F.col("n_name"), 16).alias("v"))


@HERE.add("SELECT n_name || '.eml' AS filename, 'email' AS strategy, 'From: a@example.com' || chr(10) || 'To: b@example.com, c@example.com' || chr(10) || 'Subject: ' || n_name || chr(10) || chr(10) || 'hi' || chr(13) || chr(10) AS text, 'b@example.com, c@example.com' AS \"to\", 'f.txt' AS derived, 'hi' AS body FROM nation")
def mail_extraction(spark, d):
    mail = F.concat(F.lit("From: a@example.com\r\nTo: b@example.com, c@example.com\r\nSubject: "), "n_name", F.lit('\r\nContent-Type: multipart/mixed; boundary="q"\r\n\r\n--q\r\nContent-Type: text/plain\r\n\r\nhi\r\n--q\r\nContent-Disposition: attachment; filename="f.txt"\r\nContent-Transfer-Encoding: base64\r\n\r\naGk=\r\n--q--\r\n'))
    files = table(spark, d, "nation").select(F.concat("n_name", F.lit(".eml")).alias("filename"), F.lit("message/rfc822").alias("mime"), mail.cast("binary").alias("bytes"))
    return A.extract(files).select("filename", "strategy", "text", F.col("metadata")["to"].alias("to"), F.col("derived")[0]["filename"].alias("derived"), F.col("derived")[0]["bytes"].cast("string").alias("body"))


@batch_udf("binary")
def zipped(names: pd.Series, texts: pd.Series) -> pd.Series:
    """Archives of two files each: the text, and its first word packed."""

    def pack(name: str, text: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(f"{name}.txt", text)
            z.writestr(f"{name}/first.txt", text.split(" ")[0], zipfile.ZIP_DEFLATED)
        return out.getvalue()

    return pd.Series([pack(n, t) for n, t in zip(names, texts, strict=True)])


@HERE.add("SELECT c_custkey, c_name || '.txt' AS name, octet_length(encode(c_mktsegment || ' of nation ' || c_nationkey)) AS size FROM customer UNION ALL SELECT c_custkey, c_name || '/first.txt', octet_length(encode(c_mktsegment)) FROM customer")
def zip_entries(spark, d):
    c = table(spark, d, "customer").select("c_custkey", zipped(F.col("c_name"), F.concat("c_mktsegment", F.lit(" of nation "), "c_nationkey")).alias("bytes"))
    return c.select("c_custkey", F.explode(C.list_zip(F.col("bytes"))).alias("e")).select("c_custkey", "e.name", F.col("e")["size"].alias("size"))


@batch_udf("binary")
def pictured(makes: pd.Series, models: pd.Series) -> pd.Series:
    """JPEG files that hold nothing but EXIF data, of both byte orders in turn."""

    def picture(make: str, model: str) -> bytes:
        order, mark = ("<", b"II*\0") if len(make) % 2 else (">", b"MM\0*")
        words = [w.encode() + b"\0" * max(1, 5 - len(w)) for w in (make, model)]
        entries = b"".join(struct.pack(order + "HHII", tag, 2, len(w), at) for tag, w, at in zip((0x010F, 0x0110), words, (38, 38 + len(words[0])), strict=True))
        tiff = mark + struct.pack(order + "IH", 8, 2) + entries + struct.pack(order + "I", 0) + words[0] + words[1]
        return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + b"\xff\xd9\0\0\0\0"

    return pd.Series([picture(a, b) for a, b in zip(makes, models, strict=True)])


@HERE.add("SELECT c_custkey, c_mktsegment AS make, c_name AS model, '# f.jpg' || chr(10) || 'Camera: ' || c_mktsegment || ' ' || c_name AS text FROM customer")
def exif_fields(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.lit("f.jpg").alias("filename"), F.lit("image/jpeg").alias("mime"), pictured(F.col("c_mktsegment"), F.col("c_name")).alias("bytes"))
    return A.extract(c, F.lit("exif")).select("c_custkey", F.col("metadata")["make"].alias("make"), F.col("metadata")["model"].alias("model"), "text")


@HERE.add(
    """WITH s AS (SELECT s_suppkey AS k, s_name AS n FROM supplier)
SELECT k, 'archive' AS strategy, '# a.zip' || chr(10) || chr(10) || '- ' || n || '.txt (' || length(n) || ' bytes)' || chr(10) || '- ' || n || '/first.txt (' || length(n) || ' bytes)' AS text FROM s
UNION ALL SELECT k, 'archive', '(archive: a.tar; unsupported format)' FROM s
UNION ALL SELECT k, 'text', n || chr(10) || 'plain' FROM s
UNION ALL SELECT k, 'code', 'def ' || lower(replace(n, '#', '_')) || '():' || chr(10) || '    pass' FROM s
UNION ALL SELECT k, 'spreadsheet', '(spreadsheet: t.ods; a decoder must be registered)' FROM s"""
)
def strategy_texts(spark, d):
    """Archives, plain text with a byte order mark, code, and what has no decoder."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("n"))
    kinds = [
        ("a.zip", "application/zip", None, zipped(F.col("n"), F.col("n"))),
        ("a.tar", "application/x-tar", None, F.col("n").cast("binary")),
        ("t.txt", "text/plain", None, F.concat(F.lit("\ufeff"), "n", F.lit("\nplain")).cast("binary")),
        ("c.py", "text/x-python", "code", F.concat(F.lit("def "), F.lower(F.replace("n", F.lit("#"), F.lit("_"))), F.lit("():\n    pass")).cast("binary")),
        ("t.ods", "application/vnd.oasis.opendocument.spreadsheet", None, F.col("n").cast("binary")),
    ]
    files = None
    for name, mime, strategy, data in kinds:
        part = s.select("k", F.lit(name).alias("filename"), F.lit(mime).alias("mime"), F.lit(strategy).cast("string").alias("asked"), data.alias("bytes"))
        files = part if files is None else files.unionByName(part)
    return A.extract(files, F.col("asked")).select("k", "strategy", "text")


@HERE.add(
    f"""WITH {SEGMENTS}, o AS (SELECT s.media, s.seg, k.speaker, sum(least(s."end", k."end") - greatest(s."start", k."start")) AS v, min(k.ord) AS f FROM seg s JOIN spk k ON s.media = k.media AND s."start" < k."end" AND k."start" < s."end" GROUP BY 1, 2, 3),
b AS (SELECT media, seg, arg_max(speaker, v * 1e7 - f / 1e6) AS speaker FROM o GROUP BY 1, 2), l AS (SELECT s.media, s.seg, coalesce(b.speaker, 'UNKNOWN') || ': part ' || s.seg AS line FROM seg s LEFT JOIN b USING (media, seg))
SELECT media, '# ' || media || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY seg) AS text, count(*)::INT AS segments FROM l GROUP BY media"""
)
def audio_texts(spark, d):
    segments = spans(spark, d, False, 600.0).withColumnRenamed("event_id", "seg").withColumn("text", F.concat(F.lit("part "), "seg"))
    speakers = spans(spark, d, True, 3600.0).withColumnRenamed("event_id", "ord").withColumnRenamed("event_type", "speaker")
    return A.audio_text(segments, speakers, 3600.0).select("media", "text", "segments")


@HERE.add("SELECT n_nationkey, '# ' || n_name || chr(10) || chr(10) || '## Keyframes' || chr(10) || '- [' || n_nationkey || '.5s] view ' || n_regionkey || chr(10) || CASE WHEN n_nationkey % 2 = 0 THEN chr(10) || '## Transcript' || chr(10) || '[' || n_regionkey || '.0s] said' ELSE '' END AS text FROM nation")
def video_texts(spark, d):
    n = table(spark, d, "nation")
    frames = F.array(F.struct((F.col("n_nationkey") + F.lit(0.5)).cast("double").alias("ts"), F.concat(F.lit("view "), "n_regionkey").alias("text")))
    said = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.struct(F.col("n_regionkey").cast("double").alias("start"), F.lit("said").alias("text")))).otherwise(F.array().cast("array<struct<start:double,text:string>>"))
    return n.select("n_nationkey", A.video_text(F.col("n_name"), frames, said).alias("text"))


@HERE.add("SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'image' WHEN 1 THEN 'audio' WHEN 2 THEN 'video' WHEN 3 THEN 'email' WHEN 4 THEN 'pdf' WHEN 5 THEN 'archive' WHEN 8 THEN 'text' ELSE 'spreadsheet' END AS strategy, CASE doc_id % 9 WHEN 8 THEN 'text/plain' WHEN 6 THEN 'text/csv' WHEN 0 THEN 'image/png' ELSE '' END AS named FROM documents")
def strategies(spark, d):
    """Of media types that go round over the documents; and the type of a file name."""
    kinds = ["image/png", "audio/wav", "video/mp4", "message/rfc822", "application/pdf", "application/zip", "text/csv", "application/vnd.oasis.opendocument.spreadsheet", "text/plain"]
    at = (F.col("doc_id") % 9 + 1).cast("int")
    ending = F.element_at(F.array(*[F.lit({"image/png": "png", "text/csv": "csv", "text/plain": "strange"}.get(k)) for k in kinds]), at)
    named = F.coalesce(A.mime_of(F.concat(F.col("source"), F.lit("."), ending)), F.lit(""))
    return table(spark, d, "documents").select("doc_id", A.pick_strategy(F.element_at(F.array(*[F.lit(k) for k in kinds]), at)).alias("strategy"), F.when(ending.isNull(), "").otherwise(named).alias("named"))
