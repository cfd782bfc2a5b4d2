"""Content-addressed WARC archive.

Payload bytes are stored once, under their SHA-256; exact record headers are stored apart and name that digest. Reading
verifies every stored payload against its digest, parses the headers, and rebuilds records through a join of both.
Everything is DataFrame operations; payloads cross one shuffle, in which only the first copy of each survives.

Among records of equal payloads of at least `min_bytes` bytes, the one with the least page_id is a response and the
others are revisits that refer to it; smaller payloads are always responses.

Defined results: null html is an empty payload; a null url leaves the target header out; a null page_id never becomes
the response of others and is a response only where no equal payload has an id; rows that repeat a page_id and its html
are records of one type. Only page_id, url and html are read. A payload that fails its digest stops the read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curaspark.llm.common import Store

#: RFC 4648 base-32 digits, in the order of the digits 0-9 and A-V that conv() writes.
_BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
_URN = "<urn:x-page:"


def base32_sha1(payload: Column) -> Column:
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), *_BASE32)


def _header(min_bytes: int) -> Column:
    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    def urn(ident: Column) -> Column:
        return F.concat(F.lit(_URN), F.coalesce(ident.cast("string"), F.lit("")), F.lit(">"))

    revisit = (F.col("n_bytes") >= min_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        F.when(revisit, line("WARC-Refers-To", urn(F.col("first_id")))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n_bytes").cast("string"))),
        F.lit("\r\n"),
    )


class Archive:
    """Two stored tables: headers (key, header) and payloads (key, payload); key is the payload's SHA-256."""

    def __init__(self, headers: DataFrame, payloads: DataFrame, root: str | None = None):
        self.headers, self.payloads, self.root = headers, payloads, root

    @classmethod
    def write(cls, pages: DataFrame, min_bytes: int = 0) -> Archive:
        store = Store(pages.sparkSession, "warc")
        body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
        rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
        key = F.unhex(F.sha2("payload", 256))
        heads = store.save(rows.select("page_id", "url", key.alias("key"), base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("n_bytes")), "heads")
        firsts = store.save(heads.groupBy("key").agg(F.min("page_id").alias("first_id")), "firsts")
        headers = store.save(heads.join(firsts, "key", "left").select("key", _header(min_bytes).cast("binary").alias("header")), "headers")
        # One shuffle: the join and the aggregate partition by the same plain columns, a null id being its own value.
        place = [F.coalesce("page_id", F.lit(0)).alias("place"), F.col("page_id").isNull().alias("unnamed")]
        chosen = firsts.select("key", F.coalesce("first_id", F.lit(0)).alias("place"), F.col("first_id").isNull().alias("unnamed"))
        own = rows.select(key.alias("key"), *place, "payload").join(chosen, ["key", "place", "unnamed"])
        payloads = store.save(own.groupBy("key", "place", "unnamed").agg(F.first("payload").alias("payload")).select("key", "payload"), "payloads")
        store.drop("heads", "firsts")
        return cls(headers, payloads, store.root)

    def payloads_verified(self) -> DataFrame:
        """Stored payloads by key; fails on one that does not match its key."""
        good = F.sha2("payload", 256) == F.lower(F.hex("key"))
        checked = F.when(good, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest "), F.hex("key"))).cast("binary"))
        return self.payloads.select("key", checked.alias("payload"))

    def parsed(self) -> DataFrame:
        text = F.col("header").cast("string")

        def field(name: str) -> Column:
            return F.regexp_extract(text, f"\r\n{name}: ([^\r\n]*)\r\n", 1)

        def ident(name: str) -> Column:
            return F.expr(f"try_cast(nullif(regexp_extract(cast(header AS STRING), '\r\n{name}: {_URN}(-?[0-9]*)>', 1), '') AS BIGINT)")

        return self.headers.select("key", "header", ident("WARC-Record-ID").alias("page_id"), field("WARC-Type").alias("record_type"), ident("WARC-Refers-To").alias("refers_to"), F.substring(field("WARC-Payload-Digest"), 6, 32).alias("header_sha1"), field("Content-Length").try_cast("long").alias("header_bytes"))

    def records(self) -> DataFrame:
        """Rebuilt records: page_id, the record's exact bytes, its payload (a revisit's is that of the record it refers
        to) and what its header says. Spark may split the headers of a payload that very many pages share.
        """
        both = self.parsed().join(self.payloads_verified(), "key")
        block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
        return both.select("page_id", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"), "payload", "record_type", "refers_to", "header_sha1", "header_bytes", F.octet_length("header").alias("head_bytes"))

    def index(self) -> DataFrame:
        """A row per rebuilt record: page_id, payload_bytes, payload_digest, record_type, refers_to.

        Size and digest are those of the payload read back; a record whose length or digest differs from what its header
        says stops the read.
        """
        digest = base32_sha1(F.col("payload"))
        whole = F.octet_length("record") == F.col("head_bytes") + F.col("header_bytes") + 4
        rows = self.records().select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), digest.alias("sha1"), whole.alias("whole"), "header_sha1", "record_type", "refers_to")
        good = F.col("whole") & (F.col("sha1") == F.col("header_sha1"))
        checked = F.when(good, F.col("sha1")).otherwise(F.raise_error(F.lit("a record differs from its header")).cast("string"))
        return rows.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


def open_archive(spark: SparkSession, root: str) -> Archive:
    return Archive(spark.read.parquet(f"{root}/headers"), spark.read.parquet(f"{root}/payloads"), root)
