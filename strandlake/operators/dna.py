"""Sequences: extraction from a chunked reference, reverse complements and motifs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: IUPAC letters and their complements.
LETTERS, COMPLEMENTS = "ACGTRYSWKMBDHVNacgtryswkmbdhvn", "TGCAYRSWMKVHDBNtgcayrswmkvhdbn"
CHUNK = 1 << 12


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, LETTERS, COMPLEMENTS))


def chunked(sequences: DataFrame, size: int = CHUNK) -> DataFrame:
    """sequences(chrom, seq) as (chrom, chunk, seq): pieces of `size` bases, so no row holds a chromosome.

    A sequence is cut in one pass over it, however many pieces it has.
    """
    pieces = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    # an outer explode: from another one a filter is inferred that cuts the sequence again
    cut = sequences.select("chrom", F.posexplode_outer(pieces).alias("chunk", "seq"))
    return cut.where("seq is not null").select("chrom", F.col("chunk").cast("long").alias("chunk"), "seq")


def extract(windows: DataFrame, chunks: DataFrame, sizes: DataFrame, size: int = CHUNK, outside: bool = True) -> DataFrame:
    """windows(q_id, chrom, strand, start_pos, end_pos) with their `dna`; a window for every row, equal rows included.

    On the minus strand the reverse complement. Beyond the chromosome N, or an error if
    `outside` isn't allowed. sizes: (chrom, size). A window meets only its own chunks. Chunks
    are never broadcast: made from few rows they look small, and are a whole reference.
    """
    w = windows.join(sizes, "chrom")
    s, e = F.greatest(F.col("start_pos"), F.lit(0)), F.least(F.col("end_pos"), F.col("size"))
    if not outside:
        bad = F.raise_error(F.lit("a window lies outside its chromosome")).cast("long")
        w = w.withColumn("start_pos", F.when((F.col("start_pos") >= 0) & (F.col("end_pos") <= F.col("size")), F.col("start_pos")).otherwise(bad))
    w = w.withColumns({"_s": s, "_e": F.greatest(s, e)})
    first, last = F.floor(F.col("_s") / size), F.floor((F.col("_e") - 1) / size)
    # keep empty windows: they meet no chunk
    spread = w.withColumn("chunk", F.explode_outer(F.when(F.col("_s") < F.col("_e"), F.sequence(first, last))))
    low = F.greatest(F.col("_s") - F.col("chunk") * size, F.lit(0))
    high = F.least(F.col("_e") - F.col("chunk") * size, F.lit(size))
    part = F.substring(F.col("seq"), (low + 1).cast("int"), (high - low).cast("int"))
    met = spread.join(chunks.hint("merge"), ["chrom", "chunk"], "left").withColumn("_part", F.when(F.col("seq").isNotNull(), F.struct("chunk", part.alias("p"))))
    # equal windows meet the same chunks: each piece is kept once, and the rows tell how many windows there are
    whole = met.groupBy(*windows.columns, "size", "_s", "_e").agg(F.array_sort(F.collect_set("_part")).alias("_parts"), F.count(F.lit(1)).alias("_n"))
    inner = F.array_join(F.transform("_parts", lambda p: p["p"]), "")
    before = F.repeat(F.lit("N"), F.least(F.greatest(-F.col("start_pos"), F.lit(0)), F.col("end_pos") - F.col("start_pos")).cast("int"))
    missing = (F.col("end_pos") - F.col("start_pos")).cast("int")
    padded = F.rpad(F.concat(before, inner), missing, "N")
    dna = F.when(missing <= 0, "").otherwise(padded)
    copies = F.when(F.col("_s") < F.col("_e"), F.col("_n") / (last - first + 1)).otherwise(F.col("_n")).cast("int")
    shown = whole.withColumns({"dna": F.when(F.col("strand") == "+", dna).otherwise(reverse_complement(dna)), "_n": copies})
    return shown.select(*windows.columns, "dna", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy")).drop("_copy")


#: Bases that are searched at once.
PIECE = 1 << 10


def find_motif(sequences: DataFrame, motif: str, match_position: str | int = "5p", overlapping: bool = True) -> DataFrame:
    """Hits of a motif in sequences(chrom, strand, start_pos, seq), seq being of the plus strand: the other columns and `hit`.

    A hit is an empty interval; on the minus strand the motif's reverse complement is sought
    and the position counted from its far end. Without overlaps a scan goes on after each hit.
    A sequence is cut once into pieces that overlap by all but one of the motif's bases, and each
    is searched by itself, so the work is linear and no row but the input's holds a sequence.
    """
    k = len(motif)
    at = {"5p": 0, "3p": k}.get(match_position, match_position)
    if not motif.isalpha() or not isinstance(at, int) or not 0 <= at <= k:
        raise ValueError(f"a motif of letters, and a match position within it: {motif}, {match_position}")
    table = str.maketrans(LETTERS, COMPLEMENTS)
    ahead, back = motif.upper(), motif.upper().translate(table)[::-1]
    plus = F.col("strand") == "+"
    others = [c for c in sequences.columns if c != "seq"]
    size = max(PIECE, k)
    pieces = F.regexp_extract_all("seq", F.lit(f"(?s)(?=(.{{1,{size + k - 1}}})).{{1,{size}}}"), F.lit(1))
    # an outer explode: from another one a filter is inferred that searches the sequence again
    cut = sequences.withColumn("_row", F.monotonically_increasing_id()).select(*others, "_row", F.posexplode_outer(pieces).alias("_n", "_piece"))
    # parted before every hit, however near the next one is; the first part has a hit if the piece begins with one
    parts = F.split("_piece", F.when(plus, f"(?={ahead})").otherwise(f"(?={back})"), -1)
    begins = F.col("_piece").startswith(F.when(plus, ahead).otherwise(back))
    none = F.array().cast("array<int>")
    seen = F.struct(F.lit(0).alias("at"), F.when(begins, F.array(F.lit(0))).otherwise(none).alias("hits"))
    step = lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), F.concat(acc["hits"], F.array(acc["at"] + F.length(p))).alias("hits"))
    # the last part ends where the piece does, and no hit begins there
    starts = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), seen, step)["hits"]
    hits = cut.select(*others, "_row", "_n", F.explode_outer(starts).alias("_i")).where("_i is not null")
    hits = hits.select(*others, "_row", (F.col("_n").cast("long") * size + F.col("_i")).alias("_at"))
    if not overlapping:
        hits = hits.mapInArrow(_apart(k), hits.schema)
    return hits.withColumn("hit", F.col("start_pos") + F.col("_at") + F.when(plus, at).otherwise(k - at)).drop("_row", "_at")


def _apart(k: int):
    """Keep the hits (rows in order of _row and _at) that a scan meets which goes on k bases after each hit.

    Nothing was shuffled since the sequences were read, so those of a sequence follow each other.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        row, free = None, 0
        for b in batches:
            rows, at = b.column("_row").to_numpy(), b.column("_at").to_numpy()
            # hits far enough from the one before are always kept; only the others depend on which
            far = np.ones(len(at), bool)
            far[1:] = (rows[1:] != rows[:-1]) | (at[1:] - at[:-1] >= k)
            keep = far.copy()
            if len(at) and rows[0] == row and at[0] < free:
                keep[0] = far[0] = False
            for i in np.flatnonzero(~far).tolist():
                if i and far[i - 1]:
                    free = int(at[i - 1]) + k
                if at[i] >= free:
                    keep[i], free = True, int(at[i]) + k
            if len(at):
                row = rows[-1]
                if far[-1]:
                    free = int(at[-1]) + k
            yield b.filter(pa.array(keep))

    return run
