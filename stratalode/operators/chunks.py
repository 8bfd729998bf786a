"""Files too large for a row, as rows of some lines each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalode.functions import languages as L
from stratalode.functions.text import lines, strip


def cut(files: DataFrame, most: int) -> DataFrame:
    """files (repo, path, ext, content) -> (repo, path, ext, pos, content) with at most ``most`` lines in a row."""
    all_lines = files.select("repo", "path", "ext", lines(F.col("content")).alias("ls"))
    last = F.greatest(F.ceil(F.size("ls") / most), F.lit(1)).cast("int") - 1
    rows = all_lines.withColumn("pos", F.explode(F.sequence(F.lit(0), last)))
    return rows.select("repo", "path", "ext", "pos", F.array_join(F.slice("ls", F.col("pos") * most + 1, most), "\n").alias("content"))


def logical_loc(chunks: DataFrame) -> DataFrame:
    """chunks (repo, path, ext, pos, content), each some whole lines of its file -> (repo, path, loc). A chunk becomes
    what it does to the count for either state that it may begin in, some bytes; only those meet."""
    fam = L.family(F.col("ext"))
    passage = L.loc_passage(fam, F.transform(lines(F.col("content")), strip))
    each = chunks.filter(fam.isNotNull()).select("repo", "path", F.struct("pos", passage.alias("p")).alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["p"])
    return each.groupBy("repo", "path").agg(ordered.alias("passages")).select("repo", "path", L.joined_loc(F.col("passages")).cast("int").alias("loc"))
