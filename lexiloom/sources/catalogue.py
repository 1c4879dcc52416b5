"""Catalogues of sound files and their annotations: what lies below two folders, matched by relative path. Files are listed by Spark's own reader, so any store will do; contents are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SOUND = ("wav", "flac")


def ending(path: Column) -> Column:
    """What follows the last point of a file's name, in small letters; empty without one."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))


def without_ending(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./\\]*$", "")


def supported(path: Column) -> Column:
    """Whether a file is sound by its ending, whatever its case."""
    return ending(path).isin(*SOUND)


def below(path: Column, root: Column | str) -> Column:
    """A path relative to a folder, with forward slashes; null for one that isn't below it."""
    slashed = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    top = F.rtrim(slashed(F.lit(root) if isinstance(root, str) else root), F.lit("/"))
    p = slashed(path)
    return F.when(F.startswith(p, F.concat(top, F.lit("/"))), F.substring(p, F.length(top) + 2, F.length(p)))


def annotation_path(sound: Column, sound_root: Column | str, annotation_root: Column | str) -> Column:
    """The annotation of a sound file: the same relative path below the annotations' folder, with the ending xml."""
    top = F.rtrim(F.replace(F.lit(annotation_root) if isinstance(annotation_root, str) else annotation_root, F.lit("\\"), F.lit("/")), F.lit("/"))
    return F.concat(top, F.lit("/"), without_ending(below(sound, sound_root)), F.lit(".xml"))


def files(spark: SparkSession, root: str) -> DataFrame:
    """path, relative, folder (empty at the top), name (without ending), ending, length of every file below a folder, however deep."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    plain = lambda c: F.regexp_replace(c, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", "")
    found = found.withColumn("relative", below(plain(F.col("path")), plain(F.lit(root))))
    last = F.substring_index("relative", "/", -1)
    return found.select("path", "relative", F.regexp_extract("relative", "^(.*)/[^/]*$", 1).alias("folder"), without_ending(last).alias("name"), ending(F.col("relative")).alias("ending"), "length")


def by_folder(listed: DataFrame) -> DataFrame:
    """folder, n, bytes: files right in each folder that has some."""
    return listed.groupBy("folder").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


def paired(sounds: DataFrame, annotations: DataFrame) -> DataFrame:
    """relative (without ending), sound, annotation, state: sound files and annotations (``files`` of both folders) by relative path: ``paired``, ``no annotation`` or ``no sound``. A path with both a WAV and
    a FLAC file has a row for each. Other files are left out."""
    s = sounds.where(supported(F.col("relative"))).select(without_ending(F.col("relative")).alias("relative"), F.col("path").alias("sound"))
    a = annotations.where("ending = 'xml'").select(without_ending(F.col("relative")).alias("relative"), F.col("path").alias("annotation"))
    state = F.when(F.col("annotation").isNull(), "no annotation").when(F.col("sound").isNull(), "no sound").otherwise("paired")
    return s.join(a, "relative", "full").select("relative", "sound", "annotation", state.alias("state"))
