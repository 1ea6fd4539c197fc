"""Finding inputs among copies: folders by what they hold, trees told apart by their content, what lies below another folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.errors import DiscoveryError
from evidentia.sources import tables
from evidentia.sources.artifacts import content_digest

#: Names and sections that inputs have, and how many parts a corpus has at least.
SAMPLE_NAMES = ("sample submission.csv", "sample_submission.csv")
SECTIONS = ("AA", "AB", "AC", "AD")
PART = r"wiki_\d+"
LEAST_PARTS = 250


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, sha256, folder, name) of all files below a root. Contents are read by tasks and leave them as digests."""
    found = tables.files(spark, root)
    return found.withColumns({"name": F.element_at(F.split("path", "/"), -1), "folder": F.regexp_replace("path", "/[^/]*$", "")})


def below(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, path, relative, length, sha256) of files at any depth below the folders `roots` (root): each file's ancestors meet the roots
    by equality, so no pair of a file and a folder is tried."""
    steps = F.split("folder", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    each = files.select("*", F.explode(ancestors).alias("root"))
    relative = F.substr(F.col("path"), F.length("root") + 2)
    return each.join(roots, "root").select("root", "path", relative.alias("relative"), "length", "sha256")


def signatures(files: DataFrame, roots: DataFrame, names: str | None = None) -> DataFrame:
    """(root, files, signature): what lies below each root, by relative path, length and content; names: only files whose name matches."""
    own = below(files, roots)
    own = own if names is None else own.where(F.element_at(F.split("relative", "/"), -1).rlike(f"^(?:{names})$"))
    row = F.sha2(F.concat_ws("\x1f", "relative", F.col("length").cast("string"), "sha256"), 256)
    part = lambda k: F.sum(F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return own.groupBy("root").agg(F.count("*").alias("files"), F.concat_ws("-", *[part(k) for k in range(4)]).alias("signature"))


def holding(files: DataFrame, names: list[str]) -> DataFrame:
    """(root): the folders that hold files of all the names."""
    return files.where(F.col("name").isin(*names)).groupBy(F.col("folder").alias("root")).agg(F.countDistinct("name").alias("n")).where(F.col("n") == len(set(names))).select("root")


def one_of(copies: DataFrame, what: str) -> str:
    """The root to read among (root, signature): all must be alike; the shallowest is taken, then the first."""
    kinds, first = copies.agg(F.countDistinct("signature"), F.min(F.struct(F.size(F.split("root", "/")).alias("depth"), "root"))).first()
    if first is None:
        raise DiscoveryError(f"no {what}")
    if kinds != 1:
        raise DiscoveryError(f"{kinds} different copies of {what}")
    return first["root"]


def copies_of(files: DataFrame, roots: DataFrame, name: str) -> str:
    """The first path of a file that all roots must hold alike."""
    own = files.where(F.col("name") == name).join(roots.withColumnRenamed("root", "folder"), "folder")
    n, kinds, first = own.agg(F.count("*"), F.countDistinct("sha256"), F.min("path")).first()
    if n != roots.count() or kinds != 1:
        raise DiscoveryError(f"{n} copies of {name}, {kinds} of them different")
    return first


@dataclass(frozen=True)
class Roles:
    """The files that each role reads."""

    public_train: str
    public_validation: str
    public_aggregate: str
    official: str
    test: str
    sample: str


def competition(files: DataFrame, official: str, test: str, quarantined: DataFrame | None = None, unique: bool = False) -> tuple[str, str]:
    """(root, sample): the folder with the official rows, the test rows and a sample submission, which lies below none of the folders
    `quarantined`. Copies must be alike; `unique` allows none. The preferred name of a sample comes first."""
    candidates = None
    for rank, name in enumerate(SAMPLE_NAMES):
        own = holding(files, [name, official, test]).withColumn("rank", F.lit(rank))
        candidates = own if candidates is None else candidates.union(own)
    candidates = candidates.groupBy("root").agg(F.min("rank").alias("rank"))
    if quarantined is not None:
        inside = below(files, quarantined).select(F.regexp_replace("path", "/[^/]*$", "").alias("root")).distinct()
        candidates = candidates.join(inside, "root", "left_anti")
    sample = F.element_at(F.array(*map(F.lit, SAMPLE_NAMES)), F.col("rank") + 1)
    held = files.select(F.col("folder").alias("root"), "name", "sha256").join(candidates, "root").where((F.col("name") == sample) | F.col("name").isin(official, test))
    digest = lambda n: F.max(F.when(F.col("name") == n, F.col("sha256")))
    found = held.groupBy("root", "rank").agg(F.concat_ws("-", digest(official), digest(test), digest(sample)).alias("signature"))
    n, kinds, first = found.agg(F.count("*"), F.countDistinct("signature"), F.min(F.struct("rank", "root"))).first()
    if first is None:
        raise DiscoveryError("no folder with official rows, test rows and a sample")
    if kinds != 1 or (unique and n > 1):
        raise DiscoveryError(f"{n} such folders, {kinds} of them different")
    return first["root"], f"{first['root']}/{SAMPLE_NAMES[first['rank']]}"


def roles(spark: SparkSession, root: str, train: str, validation: str, aggregate: str, official: str, test: str) -> Roles:
    """The files of each role below `root`. Public folders are those with both the training and the validation file; all must hold
    equal copies, of the aggregate too. Nothing below a public folder is taken for the competition's."""
    files = listing(spark, root).cache()
    try:
        public = holding(files, [train, validation])
        if public.isEmpty():
            raise DiscoveryError(f"no folder with {train} and {validation}")
        chosen = [copies_of(files, public, n) for n in (train, validation, aggregate)]
        folder, sample = competition(files, official, test, public)
        return Roles(*chosen, f"{folder}/{official}", f"{folder}/{test}", sample)
    finally:
        files.unpersist()


def corpus(spark: SparkSession, root: str, least: int = LEAST_PARTS) -> tuple[str, DataFrame]:
    """(root, parts): the folder whose sections hold the corpus, and (path, length, sha256) of its parts. Folders that lack a section, or have
    fewer than `least` parts, are none; of equal copies the shallowest is taken, unlike ones raise."""
    files = listing(spark, root)
    section = F.element_at(F.split("folder", "/"), -1)
    parts = files.where(F.col("name").rlike(f"^{PART}$") & section.isin(*SECTIONS)).withColumn("root", F.regexp_replace("folder", "/[^/]*$", "")).withColumn("section", section)
    full = parts.groupBy("root").agg(F.countDistinct("section").alias("sections"), F.count("*").alias("n")).where((F.col("sections") == len(SECTIONS)) & (F.col("n") >= least)).select("root")
    chosen = one_of(signatures(parts.drop("root", "section"), full, PART), "corpus")
    return chosen, parts.where(F.col("root") == chosen).select("path", "length", "sha256")


def tree_digest(files: DataFrame, root: str) -> str:
    """One digest of all that lies below a folder."""
    roots = files.sparkSession.createDataFrame([(root,)], "root string")
    return content_digest(below(files, roots).select("relative", "length", "sha256")).first()["digest"]
