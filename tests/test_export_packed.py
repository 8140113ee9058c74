"""The graph's JSON lines are packed, and whole and in order when unpacked."""

import gzip
import json

from stockweave.operators.graph import as_edges, as_nodes
from stockweave.sources import exports


def test_graph_json_is_packed_and_whole(spark, tmp_path):
    nodes = as_nodes(spark.createDataFrame([(f"T:n{i:03d}", "T", f"n{i:03d}") for i in range(200)], "id string, type string, name string"))
    edges = as_edges(spark.createDataFrame([(f"T:n{i:03d}", "x", f"T:n{i + 1:03d}") for i in range(199)], "src string, rel string, dst string"))
    exports.write_graph_json(nodes, edges, str(tmp_path / "g"))
    for kind, first, n in (("nodes", "id", 200), ("edges", "src", 199)):
        files = sorted((tmp_path / "g" / kind).glob("part-*"))
        lines = [json.loads(x) for f in files for x in gzip.decompress(f.read_bytes()).splitlines()]
        assert [x[first] for x in lines] == [f"T:n{i:03d}" for i in range(n)]
        assert spark.read.json(str(tmp_path / "g" / kind)).count() == n
