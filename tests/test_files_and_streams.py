"""Readers and writers on small files the tests write, and streams against their batch results."""
import base64
import struct
import zlib

from pyspark.sql import functions as F

from ionweave.operators import acquisition, species
from ionweave.sources import readers, writers
from ionweave.streaming import streams
from ionweave.operators.tagging import TagParams

MGF = """# a comment
BEGIN IONS
TITLE=run.12.12.2 File:"x"
PEPMASS=500.25 1000
CHARGE=2+
RTINSECONDS=10-20
SCANS=12
100.5 10
200.25 20.5
END IONS
BEGIN IONS
TITLE=second
PEPMASS=400.1
CHARGE=2+ and 3+
150.0 5
END IONS
BEGIN IONS
TITLE=broken
PEPMASS=400.1
abc def
END IONS
"""


def test_mgf_round_trip(spark, tmp_path):
    (tmp_path / "run.mgf").write_text(MGF)
    r = {x.spectrum_id: x for x in readers.read_mgf(spark, str(tmp_path / "run.mgf")).collect()}
    a, b = r['run.12.12.2 File:"x"'], r["second"]
    assert (a.precursor_mz, a.charge, a.rt, a.run_id, [tuple(p) for p in a.peaks]) == (500.25, 2, 15.0, "run", [(100.5, 10.0), (200.25, 20.5)])
    assert b.charge == 0 and b.possible_charges == [2, 3]
    assert r["broken"]._corrupt is not None and r["broken"].peaks is None
    out = str(tmp_path / "out")
    good = readers.read_mgf(spark, str(tmp_path / "run.mgf")).filter("_corrupt IS NULL")
    writers.write_mgf(good, out)
    again = readers.read_mgf(spark, out).select("spectrum_id", "precursor_mz", "charge", F.size("peaks").alias("n"))
    assert {tuple(x) for x in again.collect()} == {(a.spectrum_id, 500.25, 2, 2), ("second", 400.1, 0, 1)}


def _array(values, zipped, wide):
    raw = struct.pack(f"<{len(values)}{'d' if wide else 'f'}", *values)
    return base64.b64encode(zlib.compress(raw) if zipped else raw).decode()


def test_mzml_arrays_and_metadata(spark, tmp_path):
    cv = lambda a, v="", n="x", u="": f'<cvParam accession="{a}" value="{v}" name="{n}" unitName="{u}"/>'
    arr = lambda kind, d, z, w: f'<binaryDataArray>{cv("MS:1000523" if w else "MS:1000521")}{cv("MS:1000574" if z else "MS:1000576")}{cv(kind)}<binary>{d}</binary></binaryDataArray>'
    spec = lambda i, body, arrays: (f'<spectrum index="{i}" id="scan={i + 1}" defaultArrayLength="2">{cv("MS:1000511", 2)}<scanList><scan>{cv("MS:1000016", 1.5, "t", "minute")}</scan><scan>{cv("MS:1000016", 9)}</scan></scanList>'
                                    f'{body}<binaryDataArrayList>{arrays}</binaryDataArrayList></spectrum>')
    prec = (f'<precursorList><precursor><isolationWindow>{cv("MS:1000827", 500)}{cv("MS:1000828", 1)}{cv("MS:1000829", 2)}</isolationWindow><selectedIonList><selectedIon>{cv("MS:1000744", 500.5)}{cv("MS:1000041", 3)}</selectedIon></selectedIonList>'
            f'<activation>{cv("MS:1000422", "", "HCD")}{cv("MS:1000045", "30", "collision energy")}</activation></precursor></precursorList>')
    full = arr("MS:1000514", _array([200.5, 100.25], True, True), True, True) + arr("MS:1000515", _array([2.0, 1.0], False, False), False, False)
    none = arr("MS:1000514", "", False, True) + arr("MS:1000515", "", False, False)
    (tmp_path / "a.mzML").write_text(f"<mzML><run><spectrumList>{spec(0, prec, full)}{spec(1, '', none)}</spectrumList></run></mzML>")
    r = {x.idx: x for x in readers.read_mzml(spark, str(tmp_path / "a.mzML")).collect()}
    assert [tuple(p) for p in r[0].peaks] == [(100.25, 1.0), (200.5, 2.0)]
    assert (r[0].precursor_mz, r[0].charge, r[0].rt, r[0].iso_lower, r[0].iso_upper, r[0].run_id) == (500.5, 3, 90.0, 1.0, 2.0, "a")
    assert r[1].peaks == [] and r[1].precursor_mz is None
    readers.ingest_mzml(spark, str(tmp_path / "a.mzML"), str(tmp_path / "p"))
    assert readers.peaks_of(readers.read_spectra(spark, str(tmp_path / "p"))).count() == 2


def test_fasta_and_reduced_fasta(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">A first one\nPEPTIDE\nKR\n>B\n" + "ACDEFGHIKL" * 9 + "\n>C last\nWWW\n")
    p = readers.read_fasta(spark, str(tmp_path / "x.fasta"))
    rows = p.orderBy("ordinal").collect()
    assert [(r.accession, r.description, len(r.sequence)) for r in rows] == [("A", "first one", 9), ("B", "", 90), ("C", "last", 3)]
    keep = spark.createDataFrame([("B",), ("C",)], "accession string")
    writers.write_reduced_fasta(p, keep, str(tmp_path / "o"), None, "rev_")
    text = [r.value for r in spark.read.text(str(tmp_path / "o")).collect()]
    assert [t for t in text if t.startswith(">")] == [">B", ">C last", ">rev_B", ">rev_C last"] and max(map(len, text)) == 80


def test_tables(spark, tmp_path):
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tgenus\t|\nbad line\n2\t|\t1\t|\tgenus\t|\n")
    (tmp_path / "names.dmp").write_text("2\t|\tAlpha\t|\t\t|\tscientific name\t|\n2\t|\tOld\t|\t\t|\tsynonym\t|\n")
    nodes, names = readers.read_taxdump(spark, str(tmp_path / "nodes.dmp"), str(tmp_path / "names.dmp"))
    assert nodes.count() == 2 and [tuple(r) for r in names.collect()] == [(2, "Alpha")]
    (tmp_path / "m.obo").write_text('format-version: 1\n\n[Term]\nid: MOD:1\nname: good\nxref: DiffMono: "15.99"\nxref: Origin: "M"\nxref: TermSpec: "none"\n\n[Term]\nid: MOD:2\nname: gone\nxref: DiffMono: "1.0"\nxref: Origin: "M"\nis_obsolete: true\n\n'
                                    '[Term]\nid: MOD:3\nname: anywhere\nxref: DiffMono: "2.0"\nxref: Origin: "X"\nxref: TermSpec: "none"\n\n[Term]\nid: MOD:4\nname: term\nxref: DiffMono: "42.01"\nxref: Origin: "X"\nxref: TermSpec: "N-term"\n')
    (tmp_path / "u.xml").write_text('<umod:unimod xmlns:umod="u"><umod:mod title="Oxidation" record_id="35"><umod:specificity site="M" position="Anywhere" classification="Artefact"/><umod:specificity site="N-term" position="Any N-term" classification="Artefact"/><umod:delta mono_mass="15.994915"/></umod:mod></umod:unimod>')
    c = readers.read_mod_catalogue(spark, str(tmp_path / "u.xml"), str(tmp_path / "m.obo"))
    assert {(r.acc, r.origin, r.term) for r in c.collect()} == {("UNIMOD:35", "M", "anywhere"), ("UNIMOD:35", "X", "n_term"), ("MOD:1", "M", "anywhere"), ("MOD:4", "X", "n_term")}
    (tmp_path / "g.tsv").write_text("# note\nname\tsite\tprior\nOxidation\tM\t1.0\n")
    assert readers.read_param_table(spark, str(tmp_path / "g.tsv"), "gap_mods").first().prior == 1.0
    (tmp_path / "s.tsv").write_text("scannr\tpeptide\tspectrum_q\tsage_discriminant_score\tlabel\trank\nscan=7\tPEPT[+1]IDE\t0.001\t3.5\t1\t1\nscan=8\tAAK\t0.5\t0.1\t-1\t1\n")
    assert {(r.key, r.peptide, r.is_decoy) for r in readers.read_psms(spark, str(tmp_path / "s.tsv"), "sage").collect()} == {("7", "PEPTLDE", False), ("8", "AAK", True)}
    (tmp_path / "d.tsv").write_text("source name\tcomment[cleavage agent details]\tcomment[data file]\ns1\tNT=Trypsin;AC=MS:1001251\tr1.raw\n")
    got = {(r.run_id, r.key, r.value) for r in readers.read_sdrf(spark, str(tmp_path / "d.tsv")).collect()}
    assert ("r1", "comment[cleavage agent details]", "Trypsin") in got


def test_stream_tags_equals_batch_and_keeps_errors(spark, tmp_path):
    ladder = [147.11, 204.13146, 275.16858, 376.21626, 504.31122, 633.35381]
    block = lambda t: "BEGIN IONS\nTITLE=%s\nPEPMASS=600.0\nCHARGE=2+\n%s\nEND IONS\n" % (t, "\n".join(f"{m:.5f} {50 + i}" for i, m in enumerate(ladder)))
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.mgf").write_text(block("one") + block("two") + "BEGIN IONS\nTITLE=x\nnonsense here\nEND IONS\n")
    p = TagParams(frag_tol=0.02, tol_ppm=False)
    q = streams.stream_tags(streams.mgf_stream(spark, str(src)), str(tmp_path / "tags"), str(tmp_path / "err"), str(tmp_path / "cp"), p)
    q.awaitTermination()
    tags = spark.read.parquet(str(tmp_path / "tags"))
    ladder_tags = {"EKT", "KTA", "TAG"}
    assert {r.seq for r in tags.collect()} & {s for t in ladder_tags for s in (t, t[::-1])} >= ladder_tags
    assert tags.select("idx").distinct().count() == 2 and {"EKT", "KTA", "TAG"} <= {r.seq for r in tags.collect()}
    assert spark.read.parquet(str(tmp_path / "err")).count() == 1


def test_long_runs_are_numbered_across_tiles(spark, monkeypatch):
    monkeypatch.setattr(acquisition, "TILE", 4)
    s = spark.createDataFrame([(1, i, [5, 5, 7, 9][i % 4], 0, 0) for i in range(1, 41)], "run_id int, pos long, kx long, klo long, kup long")
    ev = acquisition.collapse_events(s)
    assert [r.event for r in ev.orderBy("pos").collect()] == list(range(1, ev.count() + 1))
    gaps = {r.gap for r in acquisition.repeat_gaps(ev).collect()}
    assert gaps == {3}


def test_species_fixed_point_and_decoys(spark):
    g = spark.createDataFrame([(1, 10, 100, 0.5, 0.5, 100.0, 200), (1, 20, 12, 0.06, 0.5, 12.0, 200), (1, 30, 40, 0.2, 0.5, 40.0, 200)],
                              "run_id int, taxid int, observed int, share double, random_expected double, n_hat double, n_units int")
    C = spark.createDataFrame([(20, 10, 0.12), (30, 10, 0.001)], "g int, h int, c double")
    got = {r.taxid: (r.call, r.reason) for r in species.call_species(g, C).collect()}
    assert got[10] == ("present", "pass") and got[30] == ("present", "pass") and got[20] == ("no_call", "near_neighbour")
    d = species.decoy_tags(spark.createDataFrame([("PEPTLDE",), ("AAAAAAG",), ("AAAA",)], "seq string"), 3).collect()
    assert all(sorted(r.decoy_seq) == sorted(r.seq) and r.decoy_seq not in (r.seq, r.seq[::-1]) for r in d)
    assert {r.seq for r in d} == {"PEPTLDE", "AAAAAAG"}
