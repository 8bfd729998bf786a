"""The import graph of Python files: who imports what, fan-in and cycles.

An import of a package means every file that is registered under its name, so importers times
files can be far more than the lines that say so. The graph is kept in parts: importers of a
name, files of a name, and edges to files beside the importer; fan-in is counted and cycles are
found on these, and nothing grows faster than import lines and files.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from stratalode.functions.languages import U
from stratalode.functions.text import in_folder, lines, name, parent, parts, stem
from stratalode.sources.tables import cut_lineage


@dataclass(frozen=True)
class ImportGraph:
    """hops (repo, src, key): who imports a name; members (repo, key, dst): the files of a name;
    near (repo, src, dst): imports of a file beside the importer. Each row once."""

    hops: DataFrame
    members: DataFrame
    near: DataFrame


def import_names(content: Column) -> Column:
    """What a Python file's import lines name: array<struct<beside, key>>, each once. ``from .m import``
    names m beside the file, any other import its first name."""
    said = F.filter(lines(content), lambda x: x.rlike(U + r"^\s*(from|import)\s"))

    def named(x: Column) -> Column:
        beside = F.regexp_extract(x, U + r"^\s*from\s+\.(\w*)\s+import", 1)
        whole = F.when(x.rlike(U + r"^\s*from\s+([\w.]+)\s+import"), F.regexp_extract(x, U + r"^\s*from\s+([\w.]+)\s+import", 1)).when(
            x.rlike(U + r"^\s*import\s+([\w.]+)"), F.regexp_extract(x, U + r"^\s*import\s+([\w.]+)", 1))
        return F.struct(beside.alias("beside"), F.when(beside == "", F.substring_index(whole, ".", 1)).alias("key"))

    return F.array_distinct(F.transform(said, named))


def linked(named: DataFrame, paths: DataFrame) -> ImportGraph:
    """The graph of files with their import names: named (repo, path, names), paths (repo, path, ext)
    of all files. A file is registered under its own stem, its top folder, and as that package's
    __init__."""
    py = paths.filter("ext = '.py'").select("repo", "path")
    path, cut = F.col("path"), parts(F.col("path"))
    keys = F.array(stem(path), F.when(F.size(cut) > 1, cut[0]), F.when(name(path) == "__init__.py", F.when(F.size(cut) > 1, F.get(cut, F.size(cut) - 2)).otherwise("")))
    members = py.select("repo", F.explode(keys).alias("key"), path.alias("dst")).filter("key IS NOT NULL").distinct()
    said = named.select("repo", F.col("path").alias("src"), F.explode("names").alias("n")).select("repo", "src", "n.*")
    folder = parent(F.col("src"))
    beside = said.filter("beside != ''").select("repo", "src", F.explode(F.array(in_folder(folder, F.concat("beside", F.lit(".py"))), in_folder(folder, F.concat("beside", F.lit("/__init__.py"))))).alias("dst"))
    near = beside.filter("src != dst").distinct().join(py.select("repo", path.alias("dst")).distinct(), ["repo", "dst"], "left_semi").select("repo", "src", "dst")
    used = members.select("repo", "key").distinct()
    hops = said.filter("key IS NOT NULL").select("repo", "src", "key").distinct().join(used, ["repo", "key"], "left_semi").select("repo", "src", "key")
    return ImportGraph(cut_lineage(hops), cut_lineage(members), cut_lineage(near))


def import_graph(files: DataFrame) -> ImportGraph:
    """The graph of files with contents, which are read once."""
    read = cut_lineage(files.select("repo", "path", "ext", F.when(F.col("ext") == ".py", import_names(F.col("content"))).alias("names")))
    return linked(read.filter(F.size("names") > 0), read)


def import_edges(graph: ImportGraph) -> DataFrame:
    """(repo, src, dst), each once, none to itself: the graph multiplied out, for those who want its edges."""
    far = graph.hops.join(graph.members, ["repo", "key"]).select("repo", "src", "dst").filter("src != dst")
    return graph.near.unionByName(far).distinct()


def fan_in(paths: DataFrame, graph: ImportGraph) -> DataFrame:
    """(repo, path, fan_in) for every Python file, 0 where nothing imports it.

    Files under the same names have the same importers by name, so those are counted once for each set of
    names: all of the most imported name, and of each other name those that import none of the ones before it.
    Importers beside a file count unless they import it by name too, and no file counts for itself."""
    sized = graph.hops.groupBy("repo", "key").agg(F.count("*").alias("n"))
    names = graph.members.join(sized, ["repo", "key"]).groupBy("repo", F.col("dst").alias("path")).agg(F.reverse(F.array_sort(F.collect_list(F.struct("n", "key")))).alias("names"))
    names = cut_lineage(names)
    imports = graph.hops.groupBy("repo", F.col("src").alias("path")).agg(F.collect_set("key").alias("imports"))
    sets = names.select("repo", "names").distinct()
    rest = sets.filter(F.size("names") > 1).select("repo", "names", F.explode(F.sequence(F.lit(1), F.size("names") - 1)).alias("i"))
    rest = rest.select("repo", "names", F.get("names", F.col("i"))["key"].alias("key"), F.transform(F.slice("names", F.lit(1), F.col("i")), lambda x: x["key"]).alias("before"))
    more = rest.join(graph.hops, ["repo", "key"]).join(imports.withColumnRenamed("path", "src"), ["repo", "src"]).filter(~F.arrays_overlap("before", "imports"))
    more = more.groupBy("repo", "names").agg(F.count("*").alias("more"))
    keys = F.transform("names", lambda x: x["key"])
    by_name = sets.join(more, ["repo", "names"], "left").select("repo", "names", (F.get("names", F.lit(0))["n"] + F.coalesce("more", F.lit(0))).alias("far"))
    far = names.join(by_name, ["repo", "names"]).join(imports, ["repo", "path"], "left")
    far = far.select("repo", "path", (F.col("far") - F.coalesce(F.arrays_overlap(keys, "imports"), F.lit(False)).cast("long")).alias("far"))
    beside = graph.near.join(names.withColumnRenamed("path", "dst"), ["repo", "dst"], "left").join(imports.withColumnRenamed("path", "src"), ["repo", "src"], "left")
    beside = beside.filter(~F.coalesce(F.arrays_overlap(keys, "imports"), F.lit(False))).groupBy("repo", F.col("dst").alias("path")).agg(F.count("*").alias("near"))
    py = paths.filter("ext = '.py'").select("repo", "path").distinct()
    whole = py.join(far, ["repo", "path"], "left").join(beside, ["repo", "path"], "left")
    return whole.select("repo", "path", (F.coalesce("far", F.lit(0)) + F.coalesce("near", F.lit(0))).cast("int").alias("fan_in"))


def import_cycles(graph: ImportGraph, most: int | None = None) -> DataFrame:
    """(repo, path, scc_id) of files in strongly connected components of two files or more; scc_id is the
    smallest path. Names are nodes between their importers and their files, which changes no path between files."""
    file, key = (lambda c: F.concat(F.lit("f"), c)), (lambda c: F.concat(F.lit("k"), c))
    used = graph.members.join(graph.hops.select("repo", "key").distinct(), ["repo", "key"], "left_semi")
    edges = graph.hops.select("repo", file("src").alias("src"), key("key").alias("dst")).unionByName(
        used.select("repo", key("key").alias("src"), file("dst").alias("dst"))).unionByName(graph.near.select("repo", file("src").alias("src"), file("dst").alias("dst")))
    found = strong_components(edges, most or IN_ONE_TASK).filter("node LIKE 'f%'").select("repo", F.substring("node", 2, 1 << 30).alias("path"), "component")
    grouped = found.groupBy("repo", "component").agg(F.min("path").alias("scc_id"), F.count("*").alias("n")).filter("n > 1")
    return found.join(grouped, ["repo", "component"]).select("repo", "path", "scc_id")


#: Edges that one task searches.
IN_ONE_TASK = 200_000


def strong_components(edges: DataFrame, most: int = IN_ONE_TASK) -> DataFrame:
    """edges (repo, src, dst) -> (repo, node, component) of strongly connected components of two nodes or more;
    component is the smallest node.

    A repository's nodes are dealt into as many blocks as it has times ``most`` edges. Each block finds the
    components among its own nodes, which are one node from then on; a small repository is one block, and
    done. What is left between blocks is searched by ``_between``."""
    blocks = F.ceil(F.col("n") / most).cast("int")
    block = lambda c: F.pmod(F.xxhash64(c), F.col("blocks")).cast("int")
    sized = edges.filter("src != dst").join(edges.groupBy("repo").agg(F.count("*").alias("n")).select("repo", blocks.alias("blocks")), "repo")
    inside = sized.withColumn("block", block("src")).filter(F.col("block") == block("dst"))
    local = cut_lineage(inside.select("repo", "src", "dst", "block").groupBy("repo", "block").applyInArrow(_components, "repo string, node string, component string"))
    joined = lambda df, c: df.join(local.select("repo", F.col("node").alias(c), F.col("component").alias(f"{c}_c")), ["repo", c], "left").withColumn(c, F.coalesce(f"{c}_c", F.col(c))).drop(f"{c}_c")
    rest = joined(joined(sized.filter("blocks > 1").select("repo", "src", "dst"), "src"), "dst").filter("src != dst").distinct()
    between = _between(rest.select("repo", "src", "dst"))
    if between is None:
        return local
    whole = local.join(between.select("repo", F.col("node").alias("component"), F.col("component").alias("wider")), ["repo", "component"], "full_outer")
    # a node that is in no local component stands for itself
    return whole.select("repo", F.coalesce("node", "component").alias("node"), F.coalesce("wider", "component").alias("component"))


def _components(table: pa.Table) -> pa.Table:
    """One block's edges -> its components of two nodes or more, by a depth-first search without recursion."""
    after: dict[str, list[str]] = {}
    for a, b in zip(table.column("src").to_pylist(), table.column("dst").to_pylist(), strict=True):
        after.setdefault(a, []).append(b)
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    open_: dict[str, None] = {}  # visited, but in no component yet, in order
    found: list[tuple[str, str]] = []
    for root in [*after]:
        if root in number:
            continue
        todo = [(root, iter(after[root]))]
        number[root] = low[root] = len(number)
        open_[root] = None
        while todo:
            node, rest = todo[-1]
            for other in rest:
                if other not in number:
                    number[other] = low[other] = len(number)
                    open_[other] = None
                    todo.append((other, iter(after.get(other, ()))))
                    break
                if other in open_:
                    low[node] = min(low[node], number[other])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[node])
                if low[node] == number[node]:
                    group = []
                    while not group or group[-1] != node:
                        group.append(open_.popitem()[0])
                    if len(group) > 1:
                        least = min(group)
                        found += [(x, least) for x in group]
    repo = table.column("repo")[0].as_py()
    return pa.table({"repo": pa.array([repo] * len(found), pa.string()), "node": pa.array([x for x, _ in found], pa.string()), "component": pa.array([x for _, x in found], pa.string())})


def _counted(df: DataFrame, count: Column) -> tuple[DataFrame, int]:
    """``df`` written, and a count over it from the same pass."""
    seen = Observation()
    table = cut_lineage(df.observe(seen, F.coalesce(count, F.lit(0)).alias("n")))
    return table, seen.get["n"]


def _between(edges: DataFrame) -> DataFrame | None:
    """Components of graphs of any size, all repositories at once; None where no edge is left.

    Every node gets a random rank. Ranks spread along the edges, forward and backward, until each node knows
    the least rank that reaches it and the least that it reaches. Where both are the same, that is the
    node's component; edges between nodes that differ in either lie in no component and go. What is left
    is ranked anew. A node also keeps one node before it and one after it as pointers and, in each
    step, takes what they know and then points where they point, so that ranks pass long chains in
    logarithmically many steps. A step is one pass that writes the nodes' state."""
    found: DataFrame | None = None
    left, n = _counted(edges, F.count("*"))
    salt = 0
    while n:
        rank = lambda c, salt=salt: F.struct(F.xxhash64(c, F.lit(salt)).alias("h"), F.col(c).alias("node"))
        ends = left.select("repo", F.col("src").alias("node"), F.lit(None).cast("string").alias("before"), F.col("dst").alias("after")).unionByName(
            left.select("repo", F.col("dst").alias("node"), F.col("src").alias("before"), F.lit(None).cast("string").alias("after")))
        pointers = [F.min(F.when(F.col(c).isNotNull(), rank(c)))["node"].alias(c) for c in ("before", "after")]
        state = ends.groupBy("repo", "node").agg(*pointers)
        # nothing reaches a node without edges into it, and it is a component of its own; so for edges out
        state = cut_lineage(state.filter("before IS NOT NULL AND after IS NOT NULL").select("repo", "node", rank("node").alias("f"), rank("node").alias("b"), "before", "after"))
        changed = 1
        while changed:
            state, changed = _counted(_step(left, state), F.count_if("changed"))
            state = state.drop("changed")
        new = state.filter("f = b").select("repo", "node", F.col("f.node").alias("of"))
        least = new.groupBy("repo", "of").agg(F.min("node").alias("component"), F.count("*").alias("n")).filter("n > 1")
        new = cut_lineage(new.join(least, ["repo", "of"]).select("repo", "node", "component"))
        found = new if found is None else found.unionByName(new)
        open_ = state.filter("f != b")
        same = left.join(open_.select("repo", F.col("node").alias("src"), "f", "b"), ["repo", "src"]).join(open_.select("repo", F.col("node").alias("dst"), "f", "b"), ["repo", "dst", "f", "b"])
        left, n = _counted(same.select("repo", "src", "dst"), F.count("*"))
        salt += 1
    return found


def _step(edges: DataFrame, state: DataFrame) -> DataFrame:
    """State (repo, node, f, b, before, after) after one more edge, and one more jump of the pointers."""
    rank, text = state.schema["f"].dataType, "string"
    none = lambda kind: F.lit(None).cast(kind)
    told = lambda f=None, b=None, before=None, after=None, f0=None, b0=None: [
        "repo", "node", *((none(k) if c is None else F.col(c)).alias(n) for n, c, k in (("f", f, rank), ("b", b, rank), ("before", before, text), ("after", after, text), ("f0", f0, rank), ("b0", b0, rank)))]
    at = lambda c: state.select("repo", F.col("node").alias(c), F.col("f").alias("tf"), F.col("b").alias("tb"), F.col("before").alias("to_before"), F.col("after").alias("to_after"))
    forward = edges.join(at("src"), ["repo", "src"]).withColumnRenamed("dst", "node").select(*told(f="tf"))
    backward = edges.join(at("dst"), ["repo", "dst"]).withColumnRenamed("src", "node").select(*told(b="tb"))
    jump_f = state.select("repo", "node", "before").join(at("before"), ["repo", "before"]).select(*told(f="tf", before="to_before"))
    jump_b = state.select("repo", "node", "after").join(at("after"), ["repo", "after"]).select(*told(b="tb", after="to_after"))
    own = state.select(*told(f="f", b="b", f0="f", b0="b"))
    every = own.unionByName(forward).unionByName(backward).unionByName(jump_f).unionByName(jump_b)
    new = every.groupBy("repo", "node").agg(*(F.min(c).alias(c) for c in ("f", "b")), *(F.max(c).alias(c) for c in ("before", "after", "f0", "b0"))).filter("f0 IS NOT NULL")
    return new.select("repo", "node", "f", "b", "before", "after", ((F.col("f") != F.col("f0")) | (F.col("b") != F.col("b0"))).alias("changed"))
