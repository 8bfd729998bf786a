"""Row-local signals of files that arrive as a stream.

Gates on paths, lines of code, comment ratio, imports and complexity look at one file
only, so they hold for streams as they do for tables. Joins between files, the graph and
licences need a whole repository; run them on the table that ``arriving`` has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratalode.functions import languages as L
from stratalode.functions.text import lines, strip
from stratalode.operators import scan


def signals(files: DataFrame) -> DataFrame:
    """files (repo, path, ext, content), batch or stream -> path gates and what one file tells."""
    kept = scan.scan_filter(files).filter(scan.hard_gate(F.col("path"), F.col("ext")))
    kept = kept.withColumns({"fam": L.family(F.col("ext")), "language": L.language(F.col("ext")), "lines": lines(F.col("content"))})
    kept = kept.withColumn("stripped", F.transform("lines", strip))
    imports = L.external_imports(F.col("fam"), F.col("lines"))
    return kept.select(
        "repo", "path", "language", L.logical_loc(F.col("fam"), F.col("stripped")).alias("loc"), L.comment_ratio(F.col("fam"), F.col("stripped")).alias("comment_ratio"),
        imports.alias("imports"), L.complexity(F.col("fam"), F.col("content")).alias("complexity"), scan.filename_score(F.col("path")).alias("filename_score"),
    )


def arriving(files: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends the signals of a stream of files to a table at ``target``; takes what is there and ends."""
    return signals(files).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
