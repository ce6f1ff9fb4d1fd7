"""Merkle fixity audit of WARC records: two replicas are compared root first, and only branches that differ are opened.

A page is a WARC response record. Its key is page_id; a leaf is what a replica holds for a key: the records' digests and
their range of offsets in the file (a file holds FILE keys; ``laid_out`` places records in the order of their keys where a
replica doesn't tell their offsets). A node of each further level covers FANOUT consecutive keys' nodes: its digest is that
of its children's keys and digests in the order of their offsets, each with the gap to the end of the one before, so a
record in another place changes it as one with other bytes does. Gaps are relative, so a record that is lost or added
changes its own branch only, not those after it. Levels are written once each; one or two roots (of the negative keys and
of the others) are above all.

Records without a key go by a key of their digest, in a tree of their own, so damage among them is located too.

Defined results: null urls and bodies are empty; rows that repeat a key are one leaf with their number of records and an
order-free digest, from the least of their offsets to the greatest end; an empty replica has no root, and each record of the
other is reported; equal roots give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import cut

#: Children of a node, and keys of a file: powers of two, so that parents are found by shifts, exact for keys of any size and sign.
FANOUT_BITS, FILE_BITS = 4, 10
FANOUT, FILE = 1 << FANOUT_BITS, 1 << FILE_BITS


def warc_records(pages: DataFrame) -> DataFrame:
    """key, digest and length (bytes) of each page's record."""
    body, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    key = F.col("page_id").cast("long")
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )
    return pages.select(key.alias("key"), F.sha2(record, 256).alias("digest"), F.octet_length(record).cast("long").alias("length"))


def _number(digest: str) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10)


def leaves(records: DataFrame) -> DataFrame:
    """One row per key: digest, n_records, start and end (offsets in the key's file). ``records`` may have an offset each."""
    told = "offset" in records.columns
    span = [F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end")] if told else []
    by_key = records.groupBy("key").agg(
        F.count("*").alias("n_records"), F.sum("length").alias("bytes"), F.min("digest").alias("low"), F.max("digest").alias("high"),
        F.sum(_number("digest").cast("decimal(38,0)")).alias("total"), *span,
    )
    several = F.sha2(F.concat_ws(":", "low", "high", F.col("total").cast("string"), F.col("n_records").cast("string")), 256)
    own = by_key.withColumn("digest", F.when(F.col("n_records") == 1, F.col("low")).otherwise(several))
    return (own if told else laid_out(own)).select("key", "digest", "n_records", "start", "end")


def laid_out(rows: DataFrame) -> DataFrame:
    """start and end of each key's bytes in its file, in the order of the keys; at most FILE keys stand in a window."""
    end = F.sum("bytes").over(Window.partitionBy(F.shiftright("key", FILE_BITS)).orderBy("key"))
    return rows.withColumn("start", end - F.col("bytes")).withColumn("end", end)


def _file(level: int) -> Column:
    """The file of a node's first key."""
    bits = FILE_BITS - level * FANOUT_BITS
    return F.shiftright("key", bits) if bits >= 0 else F.shiftleft("key", -bits)


def parents(nodes: DataFrame, level: int) -> DataFrame:
    """The next level above ``level``: at most FANOUT nodes each, hashed in the order of their offsets."""
    ordered = F.sort_array(F.collect_list(F.struct(_file(level).alias("file"), "start", "key", "end", "digest")))
    child = lambda n: F.concat_ws(":", n["key"].cast("string"), n["digest"])
    gap = F.transform(F.slice("ordered", 2, FANOUT), lambda n, i: F.when(n["file"] == F.get("ordered", i)["file"], (n["start"] - F.get("ordered", i)["end"]).cast("string")).otherwise(""))
    grouped = nodes.groupBy(F.shiftright("key", FANOUT_BITS).alias("parent")).agg(ordered.alias("ordered"), F.sum("n_records").alias("n_records"))
    # a node that spans files begins where its first file does and ends where its last does
    return grouped.select(
        F.col("parent").alias("key"), F.sha2(F.concat_ws("|", F.transform("ordered", child), gap), 256).alias("digest"), "n_records",
        F.get("ordered", F.lit(0))["start"].alias("start"), F.element_at("ordered", -1)["end"].alias("end"),
    )


def tree(leaf: DataFrame, levels: int) -> list[DataFrame]:
    """Levels from the leaves up, each written once; the last has a root for keys from 0 on and one for negative keys, where there are any."""
    out = [leaf]
    for level in range(levels):
        out.append(cut(parents(out[-1], level), "warc-nodes"))
    return out


def _compared(ours: DataFrame, theirs: DataFrame, level: int) -> DataFrame:
    """Nodes that differ, or stand elsewhere among their siblings: key, status, and the offset and n_records to report."""
    parent = F.shiftright("key", FANOUT_BITS).alias("parent")
    # dealt by parent once: the join and the windows below keep to that
    a, b = (
        side.select(parent, "key", *(F.col(c).alias(f"{name}_{c}") for c in ("digest", "n_records", "start", "end"))).repartition("parent")
        for side, name in ((ours, "a"), (theirs, "b"))
    )
    both = a.join(b, ["parent", "key"], "full").withColumn("file", _file(level))
    both = both.withColumn("shared", F.col("a_digest").isNotNull() & F.col("b_digest").isNotNull())
    for name in "ab":  # at most FANOUT rows stand in a window
        order = ("file", f"{name}_start", "key")
        both = both.withColumn(f"{name}_rank", F.row_number().over(Window.partitionBy("parent", "shared").orderBy(*order)))
        every = Window.partitionBy("parent", F.col(f"{name}_digest").isNotNull()).orderBy(*order)
        own = F.lag(F.struct("file", "key", F.col(f"{name}_digest").alias("digest"), F.col(f"{name}_end").alias("end"))).over(every)
        both = both.withColumn(f"{name}_before", F.when(own["file"] == F.col("file"), own))
    one, other = F.col("a_before"), F.col("b_before")
    # elsewhere: in another order among those that both have, or at another distance from the same node before it
    swapped = (F.col("a_rank") != F.col("b_rank")) & ~one["key"].eqNullSafe(other["key"])
    shifted = (one["key"] == other["key"]) & (one["digest"] == other["digest"]) & (F.col("a_start") - one["end"] != F.col("b_start") - other["end"])
    elsewhere = swapped | F.coalesce(shifted, F.lit(False))
    same = F.col("shared") & (F.col("a_digest") == F.col("b_digest"))
    status = F.when(F.col("b_digest").isNull(), "missing").when(F.col("a_digest").isNull(), "extra").when(~same, "altered").when(elsewhere, "moved")
    number = lambda c: F.coalesce(F.col(f"a_{c}"), F.col(f"b_{c}")).cast("long").alias(c)
    return both.select("key", status.alias("status"), number("start"), number("n_records")).where("status IS NOT NULL")


def _audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Of records that all have a key."""
    spark = primary.sparkSession
    sides = [cut(leaves(records), "warc-leaves") for records in (primary, replica)]
    reach = F.max(F.when(F.col("key") < 0, -1 - F.col("key")).otherwise(F.col("key")))
    top, levels = max(side.agg(reach).first()[0] or 0 for side in sides), 0
    while top >> (levels * FANOUT_BITS):
        levels += 1
    ours, theirs = (tree(side, levels) for side in sides)
    file, rows = F.shiftright("key", FILE_BITS), []
    # the roots: two rows each at most
    roots = [sorted((r["key"], r["digest"]) for r in t[-1].select("key", "digest").collect()) for t in (ours, theirs)]
    open_ = None if roots[0] != roots[1] else spark.createDataFrame([], "parent long")
    for level in range(levels, -1, -1):
        sides = [t[level] for t in (ours, theirs)]
        if open_ is not None:
            sides = [s.join(open_, F.shiftright(s["key"], FANOUT_BITS) == F.col("parent"), "left_semi") for s in sides]
        found = _compared(*sides, level)
        if level:
            found = cut(found, "warc-open")
            open_ = found.where("status <> 'moved'").select(F.col("key").alias("parent"))
            found = found.where("status = 'moved'").withColumn("key", F.shiftleft("key", level * FANOUT_BITS))
        rows.append(found.select("key", file.alias("file"), F.col("start").alias("offset"), "n_records", "status"))
    out = rows[-1]
    for moved in rows[:-1]:
        out = out.unionByName(moved)
    return out


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Keys whose records differ between two record tables: key, file, offset, n_records and status.

    status is missing (the replica has none), extra (the primary has none), altered (other bytes) or moved (the same bytes
    elsewhere among their neighbours; of a whole branch the first key, with the branch's number of records). The offset is
    the primary's, or the replica's for an extra key. Records without a key have null for key, file and offset.
    """
    found = _audit(*(side.where("key IS NOT NULL") for side in (primary, replica)))
    unkeyed = [side.where("key IS NULL") for side in (primary, replica)]
    if all(side.isEmpty() for side in unkeyed):
        return found
    by_digest = _audit(*(side.withColumn("key", _number("digest").cast("long")) for side in unkeyed))
    none = F.lit(None).cast("long")
    lost = by_digest.where("status <> 'moved'").select(none.alias("key"), none.alias("file"), none.alias("offset"), "n_records", "status")
    return found.unionByName(lost)


def damaged(pages: DataFrame) -> DataFrame:
    """A second copy of the pages as a failing disk would leave it: by page_id's hash, some lost, cut short or changed."""
    fate = F.substring(F.md5(F.col("page_id").cast("string")), 1, 2)
    html = F.when(fate == "0b", F.substring("html", 1, 100)).when(fate == "0c", F.regexp_replace("html", "e", "3")).otherwise(F.col("html"))
    return pages.select("page_id", "url", html.alias("html"), fate.alias("fate")).where(~F.coalesce(F.col("fate") == "0a", F.lit(False))).drop("fate")


AUDIT_ORACLE = r"""
WITH p AS (SELECT page_id::BIGINT AS key, coalesce(url, '') AS url, coalesce(html, '') AS html, coalesce(substr(md5(page_id::VARCHAR), 1, 2), '') AS fate FROM pages),
r AS (SELECT *, strlen('WARC/1.1__WARC-Type: response__WARC-Record-ID: <urn:page:' || coalesce(key::VARCHAR, '') || '>__WARC-Target-URI: ' || url || '__Content-Type: text/html__Content-Length: ' || strlen(html) || '____' || html || '____') AS n,
        CASE fate WHEN '0b' THEN substr(html, 1, 100) WHEN '0c' THEN replace(html, 'e', '3') ELSE html END AS copy FROM p),
l AS (SELECT *, floor(key / 1024.0)::BIGINT AS file, (sum(n) OVER (PARTITION BY floor(key / 1024.0) ORDER BY key))::BIGINT - n AS "offset" FROM r)
SELECT key, file, "offset", 1::BIGINT AS n_records, CASE WHEN fate = '0a' THEN 'missing' ELSE 'altered' END AS status
FROM l WHERE fate = '0a' OR copy <> html
"""
