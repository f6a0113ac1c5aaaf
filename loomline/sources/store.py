"""The object store: content-addressed rows and an append-only index, both as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import hashing, reconcile, rules
from loomline.operators.listing import by_prefix, latest_index
from loomline.session import durable
from loomline.sources import jsonl

OBJECT_LINES = "content_hash string, line int, text string, shard string"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def objects(spark: SparkSession, root: str) -> DataFrame:
    if not _exists(spark, f"{root}/objects"):
        return spark.createDataFrame([], "content_hash string, body string, shard string")
    return spark.read.schema("content_hash string, body string, shard string").parquet(f"{root}/objects")


def register(sessions: DataFrame, root: str) -> DataFrame:
    """Store sessions(content_hash, body, source_path, session_uid, kind, registered_at) and return each one's status.

    already_present objects are not written again; objects whose hash is pending are
    skipped, those whose hash is none are invalid. Objects are dealt out by the first two
    digits of their hash, so a lookup reads one folder.
    """
    spark = sessions.sparkSession
    there = objects(spark, root).select(F.col("content_hash").alias("h")).distinct()
    status = (F.when(F.col("content_hash") == "<pending>", "skipped_pending").when(F.coalesce(~F.col("content_hash").rlike("^[a-f0-9]{64}$"), F.lit(True)), "invalid")
              .when(F.col("h").isNotNull(), "already_present").otherwise("finalized"))
    marked = durable(sessions.join(there, F.col("content_hash") == F.col("h"), "left").withColumn("status", status).drop("h"))
    new = marked.filter("status = 'finalized'")
    rows = new.groupBy("content_hash").agg(F.min("body").alias("body"))
    rows.withColumn("shard", F.left("content_hash", F.lit(2))).write.mode("append").partitionBy("shard").parquet(f"{root}/objects")
    new.select("content_hash", "registered_at", "source_path", "session_uid", "kind").write.mode("append").parquet(f"{root}/index")
    return marked.select("content_hash", "source_path", "status")


def index(spark: SparkSession, root: str) -> DataFrame:
    """The last index row of each object."""
    return latest_index(spark.read.parquet(f"{root}/index"))


def rebuilt_index(spark: SparkSession, root: str, verify) -> DataFrame:
    """Index rows from the objects alone; verify(body column) gives the hash that a body has, and objects with another name are left out."""
    o = objects(spark, root)
    return o.filter(verify(F.col("body")) == F.col("content_hash")).select("content_hash").distinct()


class IndexCorrupt(ValueError):
    """An index file that is no JSON object with entries by hash."""


class IndexVersion(ValueError):
    """An index file of another version than this one reads."""


# The version of index files, and the name of an object's file.
INDEX_VERSION = 1
OBJECT_NAME = r"/([0-9a-f]{64})\.trail\.jsonl$"


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(content_hash, registered_at, source_path, session_uid, kind) of an index file `{"version": 1, "entries": {hash: {..}}}`; empty if there is no file.

    Raises IndexVersion for another version, since dropping what a newer one knows would lose
    data, and IndexCorrupt for what is no index. Only the version and the kind of the
    entries come to the driver.
    """
    schema = "content_hash string, registered_at string, source_path string, session_uid string, kind string"
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    whole = spark.read.option("wholetext", "true").text(path).select(F.try_parse_json("value").alias("v"))
    entries = F.try_variant_get("v", "$.entries", "variant")
    seen = whole.select(F.schema_of_variant("v").alias("kind"), F.to_json(F.try_variant_get("v", "$.version", "variant")).alias("version"), F.schema_of_variant(entries).alias("entries")).first()
    if seen is None or seen["kind"] is None or not seen["kind"].startswith("OBJECT"):
        raise IndexCorrupt(f"{path} is no JSON object; delete it and rebuild")
    if seen["version"] != str(INDEX_VERSION):
        raise IndexVersion(f"{path} has version {seen['version']}, not {INDEX_VERSION}; delete it and rebuild")
    if not (seen["entries"] or "").startswith("OBJECT"):
        raise IndexCorrupt(f"{path} has no entries by hash; delete it and rebuild")
    rows = whole.select(entries.alias("e")).lateralJoin(spark.tvf.variant_explode(F.col("e").outer()).select("key", "value"))
    get = lambda name: F.try_variant_get("value", f"$.{name}", "string")
    return rows.select(F.col("key").alias("content_hash"), get("registered_at").alias("registered_at"), get("source_path").alias("source_path"), get("session_uid").alias("session_uid"), F.coalesce(get("kind"), F.lit("session")).alias("kind"))


def rebuild(spark: SparkSession, folder: str) -> DataFrame:
    """What a folder of object files says about its index: a row for each file, whether it can be indexed or not.

    (file, status, detail, content_hash, registered_at, session_uid, kind). `indexed`: the file
    is named by a hash that a header of it carries and that its content has; registered_at is
    the file's time. Else `not_an_object` (another name), `unreadable` (detail: line and
    fault), `no_header`, `no_hash` (nothing in it carries a hash), `renamed` (what it carries
    is right, but is not its name), `mismatch` (detail: the hash that the content has). One
    corrupt object costs its own row and no other. Spark's readers see no file without bytes.
    """
    files = spark.read.format("binaryFile").load(folder).select(F.col("path").alias("file"), F.col("modificationTime").alias("registered_at"))
    name = F.regexp_extract("file", OBJECT_NAME, 1)
    named = durable(files.withColumn("name", F.when(name != "", name)))
    lines = durable(jsonl.strict(jsonl.lines(spark, folder).join(named.filter("name is not null").select("file"), "file", "left_semi")))
    faults = lines.filter("code is not null").select("file", F.concat_ws(" ", F.lit("line"), "line", "code").alias("fault"))
    claims = durable(reconcile.claims(lines.join(faults.select("file"), "file", "left_anti").select("file", "line", "raw")))
    of = claims.join(named.select("file", "name"), "file")
    here = F.coalesce(F.col("claim") == F.col("name"), F.lit(False))
    right = here & (F.col("verdict") == "match")
    told = of.groupBy("file").agg(
        F.max(right).alias("right"), F.max(F.col("verdict") == "match").alias("some"), F.max(F.col("claim").rlike("^[a-f0-9]{64}$")).alias("any"), F.max(F.col("group_idx") > 0).alias("headed"),
        F.min(F.when(F.col("verdict") == "mismatch", F.col("actual"))).alias("actual"), F.min_by("session_uid", F.when(F.col("group_idx") > 0, F.col("group_idx"))).alias("session_uid"),
        F.max(F.when(right & (F.col("group_idx") > 0), 1).otherwise(0)).alias("is_session"))
    out = named.join(faults, "file", "left").join(told, "file", "left")
    status = (F.when(F.col("name").isNull(), "not_an_object").when(F.col("fault").isNotNull(), "unreadable").when(~F.coalesce("headed", F.lit(False)), "no_header").when(F.col("right"), "indexed")
              .when(F.col("some"), "renamed").when(F.coalesce("any", F.lit(False)), "mismatch").otherwise("no_hash"))
    good = F.col("status") == "indexed"
    return out.withColumn("status", status).select(
        "file", "status", F.when(F.col("status") == "unreadable", F.col("fault")).when(F.col("status") == "mismatch", F.col("actual")).alias("detail"), F.when(good, F.col("name")).alias("content_hash"),
        F.when(good, F.col("registered_at")).alias("registered_at"), F.when(good, F.col("session_uid")).alias("session_uid"), F.when(good, F.when(F.col("is_session") == 1, "session").otherwise("trail")).alias("kind"))


def rebuild_counters(rebuilt: DataFrame) -> DataFrame:
    """(status, files) of a rebuild."""
    return rebuilt.groupBy("status").agg(F.count("*").alias("files"))


def export(spark: SparkSession, root: str, prefix: str) -> DataFrame:
    """The one object whose hash starts with a prefix; only its shard is read."""
    return by_prefix(objects(spark, root).filter(F.col("shard") == prefix[:2]), "content_hash", prefix).select("content_hash", "body")


def object_lines(spark: SparkSession, root: str) -> DataFrame:
    """(content_hash, line, text, shard): the canonical lines of registered files, one copy for each hash that names them."""
    if not _exists(spark, f"{root}/lines"):
        return spark.createDataFrame([], OBJECT_LINES)
    return spark.read.schema(OBJECT_LINES).parquet(f"{root}/lines")


def register_files(rows: DataFrame, root: str, registered_at) -> DataFrame:
    """Store session files, given as rows(file, line, raw bytes) of `jsonl.lines`; (file, content_hash, status) of each.

    A file with an error of validation is `invalid`. Of the others every session whose
    header carries the hash it has, and an envelope that carries the file's, is stored
    under that hash and gets an index row; without any the file is `skipped_pending`. The
    file's own hash is the envelope's, else its first stored session's; `already_present`
    if the store had it. Files with the same hash are stored once.
    """
    spark = rows.sparkSession
    parsed = durable(jsonl.strict(rows))
    bad = rules.validate(parsed).filter("severity = 'error'").select("file").distinct()
    files = parsed.select("file").distinct()
    good = durable(parsed.join(bad, "file", "left_anti").select("file", "line", "raw"))
    found = durable(reconcile.claims(good).filter("verdict = 'match'").select("file", "group_idx", "session_uid", F.col("claim").alias("content_hash")))
    there = durable(object_lines(spark, root).select("content_hash").distinct())
    # One file speaks for each new hash.
    speaks = found.groupBy("content_hash").agg(F.min("file").alias("file")).join(there, "content_hash", "left_anti")
    texts = hashing.with_canonical(good, "raw").select("file", F.col("line").cast("int").alias("line"), F.col("canon").alias("text"))
    own = F.min_by("content_hash", "group_idx")
    primary = durable(found.groupBy("file").agg(own.alias("content_hash")).join(there.withColumn("known", F.lit(True)), "content_hash", "left"))
    new = speaks.join(texts, "file").select("content_hash", "line", "text", F.left("content_hash", F.lit(2)).alias("shard"))
    new.write.mode("append").partitionBy("shard").parquet(f"{root}/lines")
    at = registered_at if not isinstance(registered_at, str) else F.lit(registered_at)
    found.select("content_hash", at.alias("registered_at"), F.col("file").alias("source_path"), F.when(F.col("group_idx") > 0, F.col("session_uid")).alias("session_uid"),
                 F.when(F.col("group_idx") > 0, "session").otherwise("trail").alias("kind")).write.mode("append").parquet(f"{root}/index")
    status = F.when(F.col("bad"), "invalid").when(F.col("content_hash").isNull(), "skipped_pending").when(F.col("known"), "already_present").otherwise("finalized")
    return files.join(bad.withColumn("bad", F.lit(True)), "file", "left").join(primary, "file", "left").select("file", "content_hash", status.alias("status"))


def by_session_uid(spark: SparkSession, root: str, uid: str) -> DataFrame:
    """Index rows of a session's stored segments."""
    return index(spark, root).filter((F.col("kind") == "session") & (F.col("session_uid") == uid))


def export_lines(spark: SparkSession, root: str, prefix: str) -> DataFrame:
    """(content_hash, line, text, intact) of the object whose hash starts with a prefix.

    Of a file with several sessions only the one with this hash, without envelope and
    siblings; `intact` says whether its lines still have the hash, null for whole files.
    """
    rows = by_prefix(object_lines(spark, root).filter(F.col("shard") == prefix[:2]), "content_hash", prefix).drop("shard")
    lines = durable(reconcile.grouped_lines(rows.select(F.col("content_hash").alias("file"), "line", F.col("text").alias("raw"))))
    named = F.try_variant_get("value", "$.content_hash", "string") == F.col("file")
    several = lines.groupBy("file").agg(F.max("group_idx").alias("n"), F.min(F.when((F.col("type") == "session") & named, F.col("group_idx"))).alias("wanted"))
    kept = durable(lines.join(several, "file").filter("n < 2 or wanted is null or group_idx = wanted").withColumn("cut", F.expr("n > 1 and wanted is not null")).select("file", "line", "raw", "cut"))
    checked = reconcile.claims(kept.filter("cut")).filter("group_idx > 0").select("file", (F.col("verdict") == "match").alias("intact"))
    return kept.join(checked, "file", "left").select(F.col("file").alias("content_hash"), "line", F.col("raw").alias("text"), "intact")


def reconcile_incoming(lines: DataFrame, root: str) -> reconcile.Reconciled:
    """New session files(file, line, raw) with the stored segments of the sessions they name, as one.

    Stored segments go by the first twelve digits of their hash. Sessions that the store
    does not know come back as they are.
    """
    spark = lines.sparkSession
    rows = reconcile.grouped_lines(lines.select("file", "line", "raw"))
    uid = F.try_variant_get("value", "$.session_uid", "string")
    asked = rows.filter(F.col("type") == "session").select(uid.alias("session_uid")).filter("session_uid is not null").distinct()
    known = index(spark, root).filter("kind = 'session'").join(asked, "session_uid", "left_semi").select("content_hash")
    stored = durable(object_lines(spark, root).join(known, "content_hash", "left_semi").select(F.left("content_hash", F.lit(12)).alias("file"), "line", F.col("text").alias("raw")))
    return reconcile.reconcile(lines.select("file", F.col("line").cast("int").alias("line"), "raw").unionByName(stored))


def share(lines: DataFrame) -> DataFrame:
    """(file, payload): whole files as text that can be sent, of (file, line, raw); a file is one value, as what is shared is small."""
    texts = F.array_sort(F.collect_list(F.struct("line", "raw")))
    whole = lines.groupBy("file").agg(F.concat(F.array_join(F.transform(texts, lambda x: x["raw"]), "\n"), F.lit("\n")).alias("text"))
    return whole.select("file", F.pandas_udf(lambda s: s.map(jsonl.encode_payload), "string")("text").alias("payload"))


def load(payloads: DataFrame, root: str, registered_at) -> DataFrame:
    """Register what came as (file, payload); (file, content_hash, status) of each, as register_files."""
    texts = payloads.select("file", F.pandas_udf(lambda s: s.map(jsonl.decode_payload), "string")("payload").alias("text"))
    parts = F.split(F.regexp_replace("text", r"\n\z", ""), "\n")
    rows = durable(texts.select("file", F.posexplode(parts).alias("at", "part")).select("file", (F.col("at") + 1).alias("line"), F.encode("part", "UTF-8").alias("raw")))
    return register_files(rows, root, registered_at)
