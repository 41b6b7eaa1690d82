"""Links from streams of raw reads equal those of the batch plan, however the reads arrive."""

import random

from skein.operators import links
from skein.sources import formats
from skein.streaming import links as streaming

K = 8


def test_any_split_into_arrivals(spark, tmp_path):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    genome = word(400)
    nodes = spark.createDataFrame([(f"n{i}", genome[40 * i : 40 * i + 55]) for i in range(9)], "node string, seq string")
    sides = {"f": [], "r": []}
    for i in range(80):
        at = rng.randrange(300)
        for side, s in (("f", genome[at : at + 40]), ("r", genome[at + 50 : at + 90] if i % 10 else "ACGNACGT")):
            sides[side].append(f"@read{i}/{1 if side == 'f' else 2} extra\n{s}\n+\n{'@' * len(s)}\n")
    for side, records in sides.items():
        (tmp_path / f"{side}.fastq").write_text("".join(records))
    batch = formats.read_fastq_pairs(spark, str(tmp_path / "f.fastq"), str(tmp_path / "r.fastq"))
    found = links.saturated(links.hits(batch, nodes, K), K)
    want = sorted(tuple(r) for r in links.fold(links.pair_links(found), links.mate_links(found)).collect())
    assert len(want) > 9

    for turn in range(2):
        base = tmp_path / str(turn)
        for side in sides:
            (base / side).mkdir(parents=True)
        pairs = streaming.stream_pairs(streaming.stream_reads(spark, str(base / "f"), 1), streaming.stream_reads(spark, str(base / "r"), 1))
        left = {}
        for side, records in sides.items():
            records = rng.sample(records, len(records)) if turn else list(records)
            cuts = sorted(rng.sample(range(1, 80), 2))
            left[side] = [records[a:b] for a, b in zip([0, *cuts], [*cuts, 80])]
        for step in range(3):  # one side runs ahead of the other; a query is stopped and goes on from its state
            for side, k in (("f", step), ("r", step - 1)):
                if k >= 0:
                    (base / side / f"{k}.fastq").write_text("".join(left[side][k]))
            query = streaming.write_links(pairs, nodes, K, str(base / "out"), str(base / "state"), availableNow=True)
            query.awaitTermination(120)
            assert not query.isActive and query.exception() is None
        (base / "r" / "2.fastq").write_text("".join(left["r"][2]))
        streaming.write_links(pairs, nodes, K, str(base / "out"), str(base / "state"), availableNow=True).awaitTermination(120)
        assert sorted(tuple(r) for r in streaming.links_so_far(spark, str(base / "out")).collect()) == want
