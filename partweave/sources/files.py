"""Finding input documents: listing, filter rules with a reason each, and one file per stem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partweave.operators.dedupe import stems
from partweave.profiles import CANONICAL, Profile

#: The first bytes of a zip archive; folders that are left out.
ZIP_MAGIC, EXCLUDED = "504B0304", ("orig_doc_files", "processed")
MB = 1024 * 1024


def listing(spark: SparkSession, folder: str, pattern: str = "*.{doc,docx}") -> DataFrame:
    """Files directly in a folder: ``path``, ``stem``, ``ext``, ``parent``, ``length`` and ``content``, which only what needs it reads."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    stem = F.expr("substring(_name, 1, char_length(_name) - char_length(_ext))")
    rows = found.withColumn("_name", name).withColumn("_ext", ext)
    parent = F.regexp_replace("path", r"/[^/]*$", "")
    return rows.select("path", stem.alias("stem"), F.col("_ext").alias("ext"), parent.alias("parent"), "length", "modificationTime", "content").withColumn("file_id", F.col("path"))


def skip_reason(profile: Profile = CANONICAL, is_zip: Column | None = None) -> Column:
    """The first rule that a file breaks, null if it breaks none. Rules in order; ``is_zip`` tells whether a .docx begins like an archive."""
    name, low = F.concat("stem", "ext"), F.lower("ext")
    zip_ok = is_zip if is_zip is not None else F.hex(F.substring("content", 1, 4)) == ZIP_MAGIC
    folders = F.split("parent", "/")
    outside = F.lit(False)
    for folder in EXCLUDED:
        outside = outside | F.array_contains(folders, folder)
    rules = (
        (~low.isin(".doc", ".docx"), "unsupported extension"),
        (~name.rlike("^[a-zA-Z0-9]"), "not alphanumeric start"),
        (name.rlike(r'[<>:"/\\|?*]'), "invalid characters"),
        (F.replace("stem", F.lit("."), F.lit("")) == "", "invalid filename"),
        (name.startswith("~"), "temporary file"),
        (name.startswith("._") | name.startswith(".DS_Store") | name.startswith("Thumbs.db") | name.startswith("desktop.ini"), "hidden file"),
        (outside, "excluded directory"),
        ((low == ".docx") & F.col("stem").endswith(profile.suffix), "already processed"),
        (F.col("length") < profile.min_file_mb * MB, "too small"),
        (F.col("length") > profile.max_file_mb * MB, "too large"),
        ((F.col("length") == 0) | ((low == ".docx") & ~zip_ok), "not a valid document"),
    )
    out = F.lit(None).cast("string")
    for test, reason in reversed(rules):
        out = F.when(test, reason).otherwise(out)
    return out


def classic_filter(files: DataFrame, profile: Profile) -> DataFrame:
    """The classic rules: no lock files, no more than the size limit."""
    return files.where(~F.concat("stem", "ext").startswith("~$") & (F.col("length") <= profile.max_file_mb * MB))


def discover(files: DataFrame, profile: Profile = CANONICAL, is_zip: Column | None = None) -> DataFrame:
    """Files that break no rule, one for each stem."""
    return stems(files.where(skip_reason(profile, is_zip).isNull()))


def output_stem(stem: Column, profile: Profile) -> Column:
    """Name of the result: the suffix once."""
    return F.when(stem.endswith(profile.suffix), stem).otherwise(F.concat(stem, F.lit(profile.suffix)))


def safe_name(name: Column) -> Column:
    """Without characters that file systems refuse."""
    return F.regexp_replace(name, r'[<>:"/\\|?*]', "_")
