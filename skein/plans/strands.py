"""One strand for each segment of a bidirected graph."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.strains import weak_components
from skein.session import ship

_COMPLEMENT = str.maketrans("ACGT", "TGCA")


def orient(segments: list[tuple], links: list[tuple]) -> tuple[list, list]:
    """segments (id, seq, dp) in order, links (src, src_ori, dst, dst_ori, overlap): nodes (id, seq, dp), edges (src, dst, overlap).

    From the best covered segment, which is taken forward, the strand goes along links. A link between the strands taken
    is an edge, the other way round if both are the others. A link that fits neither keeps the other strand too, as -id.
    """
    near: dict[str, list[tuple[str, bool]]] = {}
    for u, a, v, b, _ in links:
        near.setdefault(u, []).append((v, a == b))
        near.setdefault(v, []).append((u, a == b))
    sign: dict[str, str] = {}
    for seed, _, _ in sorted(segments, key=lambda s: -s[2]):  # stable: the first of the best
        if seed in sign:
            continue
        sign[seed], stack = "+", [seed]
        while stack:
            x = stack.pop()
            for y, same in near.get(x, ()):
                if y not in sign:
                    sign[y] = sign[x] if same else "+-"[sign[x] == "+"]
                    stack.append(y)
    flip, edges = {"+": "-", "-": "+"}, {}
    for u, a, v, b, overlap in links:
        if sign[u] != a and sign[v] != b:
            u, a, v, b = v, flip[b], u, flip[a]
        edges[u if sign[u] == a else f"-{u}", v if sign[v] == b else f"-{v}"] = overlap
    used = {x for e in edges for x in e}
    nodes = []
    for i, seq, dp in segments:
        other = seq[::-1].translate(_COMPLEMENT)
        nodes.append((i, seq if sign[i] == "+" else other, dp))
        if f"-{i}" in used:
            nodes.append((f"-{i}", other if sign[i] == "+" else seq, dp))
    return nodes, [(s, t, o) for (s, t), o in edges.items()]


def one_strand(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, seq, dp) and links (src, src_ori, dst, dst_ori, overlap) to nodes and edges (src, dst, overlap). The
    order of a component's walk matters where strands conflict, so a component is one task; components run in parallel."""
    ship(nodes.sparkSession)
    comp = weak_components(nodes, links.select("src", "dst"))
    n = nodes.join(comp, "id").select("comp", "id", "seq", "dp", F.lit("").alias("o1"), F.lit("").alias("to"), F.lit("").alias("o2"), F.lit(-1).alias("ov"))
    e = links.join(comp, links["src"] == comp["id"]).select("comp", F.col("src").alias("id"), F.lit("").alias("seq"), F.lit(0.0).alias("dp"), F.col("src_ori").alias("o1"), F.col("dst").alias("to"), F.col("dst_ori").alias("o2"), F.col("overlap").alias("ov"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s, k = pdf[pdf.ov < 0].sort_values("id"), pdf[pdf.ov >= 0].sort_values(["id", "to", "o1", "o2"])
        got = orient(list(zip(s.id, s.seq, s.dp)), list(zip(k.id, k.o1, k.to, k.o2, k.ov)))
        rows = [(i, "", q, float(d), -1) for i, q, d in got[0]] + [(a, b, "", 0.0, int(o)) for a, b, o in got[1]]
        return pd.DataFrame(rows, columns=["a", "b", "seq", "dp", "ov"])

    out = n.unionAll(e).groupBy("comp").applyInPandas(run, "a string, b string, seq string, dp double, ov int")
    return out.filter("ov < 0").select(F.col("a").alias("id"), "seq", "dp"), out.filter("ov >= 0").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("ov").alias("overlap"))
