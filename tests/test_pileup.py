"""Depths and pileups of linked reads against brute force."""

import random
from collections import Counter

from strandlake.operators import reads as rd
from strandlake.operators.dna import chunked
from strandlake.operators.scan import STRIDE


def test_depth(spark):
    rng = random.Random(3)
    rows = [(c, s, s + rng.randint(0, 9)) for c in "ab" for s in (rng.choice([0, 40, STRIDE - 5, 3 * STRIDE]) + rng.randint(0, 20) for _ in range(60))]
    rows += [("a", STRIDE - 9, 2 * STRIDE), ("a", 1, 1), ("b", None, 4), ("c", 5, 6), ("c", 5, 6), ("c", 6, 7)]
    found = rd.depth(spark.createDataFrame(rows, "chrom string, start_pos long, end_pos long").repartition(3)).collect()
    events = Counter()
    for c, s, e in rows:
        if s is not None and s < e:
            events[c, s] += 1
            events[c, e] -= 1
    wanted, depth = set(), Counter()
    steps = sorted((c, p, n) for (c, p), n in events.items() if n)
    for (c, p, n), after in zip(steps, [*steps[1:], None], strict=True):
        depth[c] += n
        if depth[c]:
            wanted.add((c, p, after[1], depth[c]))
    assert {tuple(r) for r in found} == wanted and len(found) == len(wanted)
    assert rd.depth(spark.createDataFrame([], "chrom string, start_pos long, end_pos long")).count() == 0


def test_pileup_of_reads(spark):
    rng = random.Random(4)
    genome = {c: "".join(rng.choice("ACGTacgtN") for _ in range(70)) for c in ("x", "y")}
    reads, variants, wanted = [], [], Counter()
    for _ in range(80):
        c, at = rng.choice("xy"), rng.randint(0, 58)
        left, gap, right = rng.randint(1, 4), rng.randint(1, 5), rng.randint(1, 8)
        reads.append((c, at, f"2S{left}M{gap}N{right}M"))
        under = {p: genome[c][p].upper() for p in (*range(at, at + left), *range(at + left + gap, at + left + gap + right)) if p < 70}
        p, n = rng.choice(sorted(under)), rng.randint(1, 2)
        if all(q in under for q in range(p, p + n)):
            alt = rng.choice(["", "G" * n])
            variants.append((c, p, genome[c][p : p + n], alt))
            under |= {q: "G" if alt else "DEL" for q in range(p, p + n)}
        variants.append((c, p, "", "AA"))  # put in: no count
        wanted.update((c, q, b) for q, b in under.items() if b != "N")
    chunks = chunked(spark.createDataFrame(list(genome.items()), "chrom string, seq string"), 8)
    args = spark.createDataFrame(reads, "chrom string, pos long, cigar string"), chunks
    changed = spark.createDataFrame(variants, "chrom string, start_pos long, ref string, alt string")
    rows = rd.pileup_of_reads(*args, changed, 8).collect()
    assert Counter({(r["chrom"], r["pos"], b): r[b] for r in rows for b in ("A", "C", "G", "T", "DEL") if r[b]}) == wanted
    assert len({(r["chrom"], r["pos"]) for r in rows}) == len(rows)
    plain = rd.pileup_of_reads(*args, size=8).collect()
    assert sum(r[b] for r in plain for b in "ACGT") == sum(1 for c, at, cigar in reads for p in _under(at, cigar) if p < 70 and genome[c][p] != "N")
    assert not any(r["DEL"] for r in plain)


def _under(at, cigar):
    left, rest = cigar[2:].split("M", 1)
    gap, right = rest[:-1].split("N")
    return [*range(at, at + int(left)), *range(at + int(left) + int(gap), at + int(left) + int(gap) + int(right))]
