"""Readers of small texts."""

import io
import random

import pytest

from strandlake.operators import reads as rd
from strandlake.sources import assembly, gff, sam, signal, store, twobit, ucsc, vcf

GFF = """##gff-version 3
c1\thavana\tgene\t101\t400\t.\t-\t.\tID=gene:G1;gene_id=G1.2;gene_name=ABC;gene_type=protein_coding;level=1
c1\thavana\texon\t301\t400\t.\t-\t.\tID=e1;Parent=transcript:T1
c1\thavana\texon\t101\t200\t.\t-\t.\tID=e2;Parent=transcript:T1
c1\thavana\tCDS\t151\t200\t.\t-\t2\tID=c2;Parent=transcript:T1
c1\thavana\tCDS\t301\t350\t.\t-\t0\tID=c1;Parent=transcript:T1
c1\thavana\ttranscript\t101\t400\t.\t-\t.\tID=transcript:T1;Parent=gene:G1;transcript_support_level=1 (ok)
c1\thavana\texon\t1\t2\t.\t-\t.\tID=e3;Parent=transcript:none
"""


@pytest.fixture
def text(spark):
    return lambda s: spark.createDataFrame([(x,) for x in s.splitlines()], "value string")


def test_gff(text):
    t = gff.tables(text(GFF), orphaned="exclude")
    (gene,) = t["genes"].collect()
    assert (gene["id"], gene["name"], gene["type"], gene["level"], gene["start_pos"], gene["end_pos"]) == ("G1.2", "ABC", "protein_coding", 1, 100, 400)
    (tran,) = t["transcripts"].collect()
    assert (tran["id"], tran["type"], tran["level"], tran["tsl"], tran["gene_idx"]) == ("T1", "protein_coding", 2, 1, gene["gene_idx"])
    assert [(r["start_pos"], r["index"]) for r in t["exons"].orderBy("index").collect()] == [(300, 0), (100, 1)]
    assert [(r["start_pos"], r["exon_index"], r["phase"]) for r in t["cdss"].orderBy("exon_index").collect()] == [(300, 0, 0), (150, 1, 2)]
    assert {(r["side"], r["start_pos"], r["end_pos"]) for r in t["utrs"].collect()} == {(5, 350, 400), (3, 100, 150)}
    assert gff.orphans(text(GFF)).count() == 1
    # without the orphan both ways agree; a repeated row stays repeated, and children of other types' rows are left out
    fine = GFF.rsplit("\n", 2)[0] + "\nc1\thavana\tCDS\t301\t350\t.\t-\t0\tID=c1;Parent=transcript:T1\nc1\tx\tregion\t1\t900\t.\t+\t.\tID=r\nc1\tx\texon\t1\t9\t.\t+\t.\tID=e9;Parent=r\n"
    one, two = (gff.tables(text(fine), orphaned=how) for how in ("error", "exclude"))
    for name in one:
        assert sorted(map(str, one[name].select(*two[name].columns).collect())) == sorted(map(str, two[name].collect()))
    assert one["cdss"].count() == 3 and one["exons"].count() == 2
    with pytest.raises(Exception, match="parent that isn't there: transcript:none"):
        gff.tables(text(GFF))["exons"].collect()
    with pytest.raises(Exception, match="isn't there: gene:G1"):
        gff.tables(text("\n".join(GFF.splitlines()[2:-1])))["transcripts"].collect()
    with pytest.raises(Exception, match="outside the exons"):
        gff.tables(text(fine.replace("CDS\t151", "CDS\t99")))["cdss"].collect()
    with pytest.raises(ValueError):
        gff.tables(text(GFF), orphaned="warn")


def test_ucsc(spark, tmp_path):
    (tmp_path / "g.txt").write_text("0\tNM_1\tc1\t+\t100\t400\t150\t350\t2\t100,300,\t200,400,\t0\tABC\tcmpl\tcmpl\t0,2,\n0\tNR_2\tc1\t+\t500000\t500100\t500100\t500100\t1\t500000,\t500100,\t0\tABC\tunk\tunk\t-1,\n")
    (tmp_path / "l.txt").write_text("x\tprod\tNM_1\tNP_1\t1\t1\t77\t0\nx\tprod\tNR_2\t\t1\t1\t77\t0\n")
    t = ucsc.tables(spark, str(tmp_path / "g.txt"), str(tmp_path / "l.txt"))
    assert t["exons"].count() == 3
    assert {(r["start_pos"], r["end_pos"], r["phase"]) for r in t["cdss"].collect()} == {(150, 200, 0), (300, 350, 1)}
    assert {(r["cluster"], r["type"]) for r in t["genes"].collect()} == {(0, "protein_coding"), (1, "non_coding")}


VCF = """##fileformat=VCFv4.2
##INFO=<ID=AF,Number=A,Type=Float,Description="x">
##INFO=<ID=DB,Number=0,Type=Flag,Description="x">
##INFO=<ID=SVTYPE,Number=1,Type=String,Description="x">
##FORMAT=<ID=GT,Number=1,Type=String,Description="x">
##FORMAT=<ID=AD,Number=R,Type=Integer,Description="x">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2
c1\t11\trs1\tA\tC\t.\t.\tAF=0.5;DB\tGT:AD\t0/1:3,4\t1|1:0,9
c1\t21\t.\tAT\tA\t.\t.\tAF=.\tGT:AD\t./.\t0|1:1,2
c1\t31\t.\tA\t<DEL>\t.\t.\tSVTYPE=DEL;END=50;AF=1\tGT:AD\t0/0:1,1\t./1:2,2
"""


def test_vcf(spark, tmp_path):
    path = tmp_path / "x.vcf"
    path.write_text(VCF)
    rows = vcf.read(spark, str(path), ["AF", "DB", "SVTYPE", "ID"], {"GT": None, "AD": -1}).orderBy("start_pos").collect()
    assert [(r["start_pos"], r["end_pos"], r["ref"], r["alt"]) for r in rows] == [(10, 11, "A", "C"), (21, 22, "T", ""), (31, 50, "", "<DEL>")]
    assert [(r["AF"], r["DB"], r["SVTYPE"], r["ID"]) for r in rows] == [(0.5, True, 0, "rs1"), (0.0, False, 0, "."), (1.0, False, 1, ".")]
    assert [[(s["GT"], list(s["AD"])) for s in r["samples"]] for r in rows] == [[(1, [3, 4]), (2, [0, 9])], [(3, [-1, -1]), (4, [1, 2])], [(0, [1, 1]), (1, [2, 2])]]
    assert vcf.sample_names(spark, str(path)) == ["s1", "s2"]
    path.write_text(VCF.replace("A\tC\t", "A\tC,G\t"))
    with pytest.raises(Exception, match="multi-allelic"):
        vcf.read(spark, str(path)).collect()


def test_sam(text):
    lines = "@HD\tx\nr1\t0\tc\t11\t255\t3M5N2M1D4M\t*\t0\t0\t*\t*\nr2\t1024\tc\t1\t9\t5M\t*\t0\t0\t*\t*\nr3\t16\tc\t5\t9\t2S3M2I4M\t*\t0\t0\t*\t*"
    a = sam.alignments(text(lines))
    assert [r["name"] for r in a.orderBy("name").collect()] == ["r1", "r3"]
    (j,) = rd.junctions(a).collect()
    assert (j["start_pos"], j["end_pos"], j["left"], j["right"]) == (13, 18, 3, 6)
    assert {(r["name"], r["segment"], r["start_pos"], r["end_pos"]) for r in rd.segments(a).collect()} == {("r1", 0, 10, 13), ("r1", 1, 18, 25), ("r3", 0, 4, 11)}
    for bad in ("3M5X", "", "0M", "M", "3M4"):
        with pytest.raises(Exception, match="CIGAR"):
            rd.junctions(text("r\t0\tc\t1\t9\t" + bad + "\t*\t0\t0\t*\t*").transform(sam.alignments)).collect()


def test_signal(spark, text, tmp_path):
    wig = "track x\nfixedStep chrom=c start=3 step=2 span=2\n1\n2.5\nvariableStep chrom=d span=3\n7 4\n"
    (tmp_path / "a.wig").write_text(wig)
    rows = [tuple(r) for r in signal.wig(spark, str(tmp_path / "a.wig")).orderBy("chrom", "start_pos").collect()]
    assert rows == [("c", "+", 2, 4, 1.0), ("c", "+", 4, 6, 2.5), ("d", "+", 6, 9, 4.0)]
    with pytest.raises(ValueError, match="span"):
        list(signal.wig_rows(["fixedStep chrom=c start=1 step=3 span=2"]))
    assert [r["value"] for r in signal.bed_rows(text("c\t0\t5\tb"), ["a", "b"], stranded=False).collect()] == [1.0]
    assert [r["value"] for r in signal.bed_rows(text("c\t0\t5"), stranded=False).collect()] == [1.0]
    with pytest.raises(Exception, match="category"):
        signal.bed_rows(text("c\t0\t5\tz"), ["a"], stranded=False).collect()
    with pytest.raises(Exception, match="strand"):
        signal.bed_rows(text("c\t0\t5\tz\t1\t+"), stranded=False).collect()


def test_wig_rules():
    rows = lambda *lines: [r[2:] for r in signal.wig_rows(lines, resolution=5)]
    fixed = "fixedStep chrom=c start={} step={} span={}".format
    assert rows(fixed(6, 5, 5), "1", "2", fixed(16, 3, 3), "3", "fixedStep chrom=d span=5 step=5", "4") == [(5, 10, 1.0), (10, 15, 2.0), (15, 18, 3.0), (0, 5, 4.0)]
    assert rows(fixed(1, 3, 3), "1", fixed(6, 5, 5), "2") == [(0, 3, 1.0), (5, 10, 2.0)]
    for wrong, lines in {
        "multiple": [fixed(2, 5, 5)], "resolution": [fixed(1, 3, 3), "1", "2"], "before": [fixed(6, 5, 5), "1", fixed(1, 5, 5), "1"], "equals": ["fixedStep chrom=c step=5", "1"],
        "last block": ["variableStep chrom=c span=3", "1 1", "variableStep chrom=c span=5", "11 1"], "goes on": [fixed(1, 5, 5), "1", "variableStep chrom=c span=5", "11 1"], "header": ["1"],
    }.items():
        with pytest.raises(ValueError, match=wrong):
            rows(*lines)


@pytest.mark.parametrize("most", [signal.SPLITS, 0])
def test_wig_in_splits(spark, tmp_path, monkeypatch, most):
    """However a file is cut, its rows are those of one reader, and so are its faults."""
    monkeypatch.setattr(signal, "SPLITS", most)
    rng, lines, at = random.Random(5), ["track x", "# c"], 0
    for k in range(21):  # sections without rows, of one, and of many splits
        n = rng.choice([0, 1, 3, 40])
        at += 10_000
        lines += [f"fixedStep chrom=c{k // 7} start={at + 1} step=5 span=5", *(str(rng.randint(0, 9)) for _ in range(n)), ""] if k % 2 else [f"variableStep chrom=c{k // 7} span=5", *(f"{at + 5 * i + 1} {i}" for i in range(n))]
        at += 5 * n
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.wig").write_text("\n".join(lines) + "\n")
    (tmp_path / "w/b.wig").write_text("\n".join(lines[9:][next(i for i, x in enumerate(lines[9:]) if "Step" in x) :]))
    (tmp_path / "w/none.wig").write_text("")
    wanted = [r for p in ("a", "b") for r in signal.wig_rows((tmp_path / f"w/{p}.wig").read_text().split("\n"), resolution=5)]
    bad = "\n".join(["variableStep chrom=c span=5", *(f"{5 * i + 1} 1" for i in range(50)), "fixedStep chrom=c start=251 step=5 span=5", "1"])
    (tmp_path / "bad.wig").write_text(bad)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for piece in (61, 400):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(piece))
            assert spark.read.text(str(tmp_path / "w")).rdd.getNumPartitions() > 5
            assert sorted(tuple(r) for r in signal.wig(spark, str(tmp_path / "w"), resolution=5).collect()) == sorted(wanted)
            with pytest.raises(Exception, match="goes on"):
                signal.wig(spark, str(tmp_path / "bad.wig"), resolution=5).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_assembly(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# ucsc\tgenbank\nchr1\tCM1\nchrM\t\n")
    assert {tuple(r) for r in assembly.chrom_aliases(spark, str(tmp_path / "a.txt")).collect()} == {("chr1", "ucsc", "chr1"), ("chr1", "genbank", "CM1"), ("chrM", "ucsc", "chrM")}
    (tmp_path / "p.tsv").write_text("G\tE1\tT1\t-\tPRINCIPAL:2\nG\tE1\tT2\t-\tMINOR\n")
    assert [(r["transcript_id"], r["principality"]) for r in assembly.appris(spark, str(tmp_path / "p.tsv")).collect()] == [("T1", 1)]


def test_twobit(spark, tmp_path):
    sequences = {"c1": "ACGTNNNNacgtTTGACNA", "c2": "", "c3": "g" * 9}
    data = twobit.encode(sequences)
    back: dict = {n: "" for n in sequences}
    for name, _, seq in twobit.parse(data, 5):
        back[name] += seq
    assert back == sequences
    (tmp_path / "x.2bit").write_bytes(data)
    assert twobit.read(spark, str(tmp_path / "x.2bit"), 8).count() == 5


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        data = super().read(n)
        self.taken += len(data)
        return data


def test_twobit_by_ranges(spark, tmp_path, monkeypatch):
    """Files written by tasks are read in ranges, blocks that reach over chunks included; a range reads a small part of its file."""
    rng = random.Random(3)
    sequences = {f"c{k}": "".join(rng.choice(["ACGTTGCA", "N" * rng.randrange(1, 9), "acgtn"])[: rng.randrange(9)] for _ in range(k * 20)) for k in range(7)}
    sequences["long"] = "ACGT" * 50 + "N" * 700 + "acgt" * 200 + "A"
    want = sorted((c, k // 16, s[k : k + 16].upper()) for c, s in sequences.items() for k in range(0, len(s), 16))
    monkeypatch.setattr(twobit, "RANGE", 64)
    folder = f"file://{tmp_path}/written"
    written = twobit.write(spark.createDataFrame(list(sequences.items()), "chrom string, seq string").repartition(3), folder)
    assert sorted(r["chrom"] for r in written.collect()) == sorted(sequences)
    got = twobit.read(spark, folder, 16)
    assert sorted((r["chrom"], r["chunk"], r["seq"].upper()) for r in got.collect()) == want
    data = twobit.encode(sequences)
    at = {n: (a, little) for n, a, _, little in twobit.index(io.BytesIO(data))}
    for _ in range(300):
        name = rng.choice(list(sequences))
        low, high = sorted(rng.randrange(len(sequences[name]) + 1) for _ in range(2))
        assert twobit.bases(io.BytesIO(data), at[name][0], low, high, at[name][1]) == sequences[name][low:high]
    big = io.BytesIO(twobit.encode({"x": "ACGTacgtNN" * 200_000}))
    file = Counted(big.getvalue())
    assert twobit.bases(file, 16 + 6, 1_000_000, 1_004_096, True) == ("ACGTacgtNN" * 200_000)[1_000_000:1_004_096]
    assert file.taken < 10_000 < len(big.getvalue()) // 100


def test_store(spark, tmp_path):
    df = spark.createDataFrame([("t1", "c1", 5, 9), ("t2", "c2", 1, 3)], "id string, chrom string, start_pos long, end_pos long")
    path = str(tmp_path / "t")
    store.write_table(df, path, "track")
    back = store.read_table(spark, path, "track")
    assert sorted(tuple(r) for r in back.select(*df.columns).collect()) == sorted(tuple(r) for r in df.collect())
    with pytest.raises(ValueError, match="not a table"):
        store.read_table(spark, path, "variants")
    source = tmp_path / "s.txt"
    source.write_text("x")
    calls = []
    build = lambda: calls.append(1) or df
    for _ in range(2):
        assert store.cached(spark, [str(source)], {"a": 1}, str(tmp_path / "cache"), "track", build).count() == 2
    assert len(calls) == 1


def test_fasta(spark):
    s = spark.createDataFrame([("c", "ACGTA")], "chrom string, seq string")
    assert [r["value"] for r in store.fasta_lines(s, 2).orderBy("line").collect()] == [">c", "AC", "GT", "A"]


def test_vcf_header_is_read_from_the_beginning(spark, tmp_path):
    """However long the header is, and not from lines further down."""
    from strandlake.sources import vcf

    meta = [f'##INFO=<ID=A{i},Number=1,Type=Integer,Description="x">' for i in range(1500)]
    rows = ["\t".join(["c", str(i), ".", "A", "C", ".", ".", "A7=1", "GT", "0/1"]) for i in range(1, 50)] + ['##INFO=<ID=LATE,Number=1,Type=Integer,Description="x">']
    (tmp_path / "a.vcf").write_text("\n".join([*meta, "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1", *rows]) + "\n")
    info, fmt, names = vcf.header(spark, str(tmp_path))
    assert len(info) == 1500 and "LATE" not in info and fmt == {} and names == ["s1"]


def test_vcf_fields_are_split_once_a_row(spark, tmp_path):
    """Expressions within lambdas are evaluated at every mention, so a mention of a split line or sample is a split."""
    from strandlake.sources import vcf

    head = ["##fileformat=VCFv4.2", '##FORMAT=<ID=GT,Number=1,Type=String,Description="x">', '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="x">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2"]
    rows = ["c\t1\tr1\tA\tC\t.\t.\t.\tAD:GT\t3,4:0|1\t.", "c\t2\tr2\tA\tC\t.\t.\t.\tGT\t1/1\t./1:9,9"]
    path = f"{tmp_path}/x.vcf"
    with open(path, "w") as f:
        f.write("\n".join(head + rows))
    got = vcf.read(spark, path, (), ["GT", "AD"])
    assert {r["id"]: [tuple(s) for s in r["samples"]] for r in got.collect()} == {"r1": [(4, [3, 4]), (3, [0, 0])], "r2": [(2, [0, 0]), (1, [0, 0])]}
    plan = got.select("samples")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 8


def test_tables_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(4000).selectExpr("'c' AS chrom", "id * 7 % 4000 AS start_pos")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.write_table(rows, f"{tmp_path}/t", "variants")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = store.read_table(spark, f"{tmp_path}/t", "variants")
    sizes = [r["count"] for r in back.selectExpr("_metadata.file_name AS f").groupBy("f").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 2000


def test_gff_lines_are_read_a_few_times(text, tmp_path, spark):
    """Genes, transcripts and the names of parents are made once; before, the lines were read anew for each step that uses them."""
    path = f"{tmp_path}/lines.gff3"
    fine = GFF.rsplit("\n", 2)[0] + "\n"
    text(fine).coalesce(1).write.text(path)
    t = gff.tables(spark.read.text(path))
    whole = t["exons"].join(t["transcripts"], "tran_idx").join(t["genes"].select("gene_idx", "id"), "gene_idx")
    leaves = whole._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert sum("value" in leaves.apply(i).toString() for i in range(leaves.size())) == 1 and whole.count() == 2
