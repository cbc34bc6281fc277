"""Scans of the files around an index: metadata, vectors, screen text, speech, maps, word lists, media listings."""

from __future__ import annotations

import io
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright import catalog
from framewright.functions.text import padded

VIDEO_SUFFIXES, IMAGE_SUFFIXES = ("mp4", "mkv", "avi", "mov", "webm"), ("jpg", "jpeg", "png", "webp")


def metadata_csv(spark: SparkSession, path: str) -> DataFrame:
    """Keyframe metadata by its schema, so that ids keep their zeros."""
    return spark.read.schema(catalog.METADATA).option("header", True).csv(path)


def key_of_path(path: Column) -> Column:
    """struct(dataset, video_id, stem) of .../dataset/video/stem.suffix."""
    parts = F.split(path, "/")
    return F.struct(F.element_at(parts, -3).alias("dataset"), F.element_at(parts, -2).alias("video_id"), F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "").alias("stem"))


def keyframe_of_stem(stem: Column) -> Column:
    """struct(keyframe_id_int, keyframe_id, frame_idx): a stem of digits; debug_(n)_frame_(m); else its first number, and its last if there are several; other stems are an error."""
    numbers = F.regexp_extract_all(stem, F.lit(r"(\d+)"))
    marked = F.regexp_extract(stem, r"debug_(\d+)_frame_(\d+)", 1)
    none = F.lit(None).cast("int")
    number = F.when(stem.rlike(r"^\d+$"), stem).when(marked != "", marked).when(F.size(numbers) > 0, F.get(numbers, F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("no keyframe in "), stem)))
    frame = F.when(stem.rlike(r"^\d+$"), none).when(marked != "", F.regexp_extract(stem, r"debug_(\d+)_frame_(\d+)", 2).cast("int")).when(F.size(numbers) > 1, F.element_at(numbers, -1).cast("int")).otherwise(none)
    return F.struct(number.cast("int").alias("keyframe_id_int"), padded(number.cast("int")).alias("keyframe_id"), frame.alias("frame_idx"))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def load_npy(content: pd.Series) -> pd.Series:
    return content.map(lambda b: np.load(io.BytesIO(b), allow_pickle=False).astype(np.float32).ravel())


def npy_vectors(spark: SparkSession, path: str) -> DataFrame:
    """All .npy files below a path: dataset, video_id, keyframe ids, embedding."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", True).load(path)
    keyed = files.select("path", key_of_path(F.col("path")).alias("k"), load_npy("content").alias("embedding"))
    return keyed.select("path", "k.*", keyframe_of_stem(F.col("k.stem")).alias("f"), "embedding").select("path", "dataset", "video_id", "stem", "f.*", "embedding")


def _whole(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(path)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return files.select(F.element_at(parts, -2).alias("dataset"), F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "").alias("video_id"), "value")


def ocr_json(spark: SparkSession, path: str, lenient: bool = False, suffix: str = ".json") -> DataFrame:
    """{keyframe: [boxes, texts(, confidences)]} files as OCR documents; other arities are an error, or, leniently, left out."""
    rows = _whole(spark, path, suffix).select("dataset", "video_id", F.explode(F.from_json("value", "map<string,array<string>>")).alias("keyframe_id", "parts"))
    fits = F.size("parts").isin(2, 3)
    rows = rows.where(fits) if lenient else rows.where(F.when(fits, True).otherwise(F.raise_error(F.concat(F.lit("two or three lists expected at "), "video_id", F.lit("/"), "keyframe_id"))))
    return rows.select("dataset", "video_id", "keyframe_id", F.from_json(F.get("parts", F.lit(0)), "array<array<double>>").alias("bboxs"), F.from_json(F.get("parts", F.lit(1)), "array<string>").alias("texts"), F.from_json(F.get("parts", F.lit(2)), "array<double>").alias("confidences"))


def string_leaves(value) -> list[str]:
    """All strings in nested lists and maps that aren't blank, in order."""
    if isinstance(value, str):
        return [value] if value.strip() else []
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return [leaf for item in inner for leaf in string_leaves(item)]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("keyframe_id", T.StringType()), T.StructField("texts", T.ArrayType(T.StringType()))])))
def _frames_with_text(files: pd.Series) -> pd.Series:
    def frames(text):
        try:
            found = json.loads(text)
        except ValueError:
            return []
        rows = [(str(k), string_leaves(v)) for k, v in found.items()] if isinstance(found, dict) else []
        return [{"keyframe_id": k, "texts": t} for k, t in rows if t]

    return files.map(frames)


def screen_text_json(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """{keyframe: anything} files as OCR documents of all strings below each keyframe; files that aren't such JSON and keyframes without text are passed over."""
    rows = _whole(spark, path, suffix).select("dataset", "video_id", F.explode(_frames_with_text("value")).alias("f"))
    return rows.select("dataset", "video_id", "f.*")


def asr_json(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """[{start, end, transcript}] files, or with the keys start_time, end_time and text, as speech segments; the file's name is the video.  Files that aren't such JSON are passed over."""
    item = "array<struct<start:double,end:double,transcript:string,start_time:double,end_time:double,text:string>>"
    rows = _whole(spark, path, suffix).select("dataset", "video_id", F.explode(F.from_json("value", item)).alias("s"))
    return rows.select("dataset", "video_id", F.coalesce("s.start", "s.start_time").alias("start_time"), F.coalesce("s.end", "s.end_time").alias("end_time"), F.coalesce("s.transcript", "s.text").alias("text")).where("start_time is not null or end_time is not null or text is not null")


def keyframe_maps(spark: SparkSession, path: str) -> DataFrame:
    """All map files below a path in one scan; the columns idx and timestamp count as frame_idx and timestamp_sec."""
    df = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(path)
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in df.columns], F.lit(None))
    return df.select(pick("keyframe_id").cast("int").alias("keyframe_id"), pick("video_id").alias("video_id"), pick("frame_idx", "idx").cast("int").alias("frame_idx"), pick("timestamp_sec", "timestamp").cast("double").alias("timestamp_sec"), pick("fps").cast("double").alias("fps"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("token")).where("token <> '' and not startswith(token, '#')").distinct()


def hunspell_stems(spark: SparkSession, path: str) -> DataFrame:
    """The words of a .dic file in lower case, without their count line and affix flags; several files make one list."""
    stem = F.lower(F.trim(F.regexp_replace("value", r"/.*$|\t.*$", "")))
    return spark.read.text(path).select(stem.alias("token")).where(r"token <> '' and not token rlike '^[0-9]+$'").distinct()


def affix_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rules of an .aff file: kind (PFX or SFX), flag, joins (whether a prefix and a suffix may meet), cut, added, and the pattern that the cut end must have."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where("p[0] in ('PFX', 'SFX')")
    heads = parts.where("size(p) = 4 and p[2] in ('Y', 'N')").select(F.get("p", F.lit(0)).alias("kind"), F.get("p", F.lit(1)).alias("flag"), (F.get("p", F.lit(2)) == "Y").alias("joins"))
    none = lambda i: F.when(F.get("p", F.lit(i)) == "0", "").otherwise(F.get("p", F.lit(i)))
    rules = parts.where("size(p) > 4 or size(p) = 4 and p[2] not in ('Y', 'N')").select(
        F.get("p", F.lit(0)).alias("kind"), F.get("p", F.lit(1)).alias("flag"), none(2).alias("cut"), F.regexp_replace(none(3), "/.*$", "").alias("added"), F.coalesce(F.get("p", F.lit(4)), F.lit(".")).alias("pattern")
    )
    return rules.join(F.broadcast(heads), ["kind", "flag"])  # a row per flag


def hunspell_words(spark: SparkSession, dic: str, aff: str) -> DataFrame:
    """The words of a .dic file in lower case with all forms that the .aff rules give them: suffixes, prefixes, and both where the rules may meet."""
    rules = affix_rules(spark, aff)
    entry = F.split(F.regexp_replace(F.trim("value"), r"\t.*$", ""), "/")
    stems = spark.read.text(dic).select(F.get(entry, F.lit(0)).alias("word"), F.split(F.coalesce(F.get(entry, F.lit(1)), F.lit("")), "").alias("flags")).where(r"word <> '' and not word rlike '^[0-9]+$'")

    def forms(words: DataFrame, kind: str, only_joining: bool) -> DataFrame:
        some = rules.where((F.col("kind") == kind) & (F.col("joins") | F.lit(not only_joining)))
        met = words.select("word", "flags", F.explode("flags").alias("flag")).join(F.broadcast(some), "flag")  # the rules of one language
        n, end = F.length("cut"), kind == "SFX"
        fits = F.expr("word rlike concat('(?:', pattern, ')$')" if end else "word rlike concat('^(?:', pattern, ')')")
        holds = F.endswith("word", F.col("cut")) if end else F.startswith("word", F.col("cut"))
        made = F.concat(F.substr("word", F.lit(1), F.length("word") - n), "added") if end else F.concat("added", F.substr("word", n + 1))
        return met.where(fits & holds & (F.length("word") > n)).select(made.alias("word"), "flags", "joins")

    ends = forms(stems, "SFX", False)
    whole = stems.select("word").union(ends.select("word")).union(forms(stems, "PFX", False).select("word")).union(forms(ends.where("joins").select("word", "flags"), "PFX", True).select("word"))
    return whole.select(F.lower("word").alias("token")).distinct()


def frequency_tsv(spark: SparkSession, path: str, words: int = 1) -> DataFrame:
    """word(s) and count, tab by tab; a header and bad rows are passed over."""
    names = [f"w{i + 1}" for i in range(words)] if words > 1 else ["token"]
    schema = ", ".join(f"{n} string" for n in names) + ", n long"
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").option("mode", "DROPMALFORMED").csv(path).where("n is not null")


def write_vocabulary(words: DataFrame, path: str, name: str = "vocab") -> None:
    """``(token, df)`` as lines of JSON, each a document of one token that vocabulary_json() reads."""
    entry = F.create_map("token", F.col("df").cast("long"))
    words.select(F.to_json(F.struct(entry.alias(name))).alias("value")).write.mode("overwrite").text(path)


def vocabulary_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The keys of "vocab" or "watermark_tokens" with their counts; of one document a file, or, with lines, a line."""
    raw = spark.read.option("wholetext", not lines).text(path).select(F.from_json("value", "struct<vocab:map<string,long>,watermark_tokens:map<string,long>>").alias("j"))
    return raw.select(F.explode(F.coalesce("j.vocab", "j.watermark_tokens")).alias("token", "df"))


def listing(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> DataFrame:
    """path, key and length of the files with one of the suffixes, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    return files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*suffixes)).select("path", "length", "modificationTime", key_of_path(F.col("path")).alias("k")).select("path", "length", "modificationTime", "k.*")


def keyframe_files(frames: DataFrame, files: DataFrame) -> DataFrame:
    """frames ``(dataset, video_id, source_name, keyframe_id_int)`` with the file of each: by source name, padded number or
    plain number, .jpg before .jpeg, .png and .webp; without one the path a .jpg would have."""
    names = F.array(F.col("source_name"), padded(F.col("keyframe_id_int")), F.col("keyframe_id_int").cast("string"))
    wanted = frames.select("*", F.posexplode(names).alias("__n", "stem"))
    suffix = F.array_position(F.lit(list(IMAGE_SUFFIXES)), F.lower(F.element_at(F.split("path", r"\."), -1)))
    found = wanted.join(files.select("dataset", "video_id", "stem", "path", suffix.alias("__s")), ["dataset", "video_id", "stem"])
    best = found.groupBy("dataset", "video_id", "keyframe_id_int").agg(F.min_by("path", F.struct("__n", "__s")).alias("path"))
    default = F.concat_ws("/", "dataset", "video_id", F.concat(padded(F.col("keyframe_id_int")), F.lit(".jpg")))
    return frames.join(best, ["dataset", "video_id", "keyframe_id_int"], "left").withColumn("path", F.coalesce("path", default))


def recognised_lines(answer: Column) -> Column:
    """Lines of a recogniser's answer, trimmed, without blanks; "NO_TEXT" has none."""
    lines = F.filter(F.transform(F.split(answer, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.trim(answer) == "NO_TEXT", F.array().cast("array<string>")).otherwise(lines)
