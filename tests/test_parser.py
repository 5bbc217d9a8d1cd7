import glob
import os
from decimal import Decimal

from pyspark.sql import functions as F

from conftest import make_line
from ledgerline import layout as L
from ledgerline.operators import classify as C
from ledgerline.plans import driver_queries as D
from ledgerline.sources import registry_text as RT

SITS = ["01", "03", "05", "04", "21", "11", "23", "01", "01", "03"]


def _split(spark, path):
    lines = RT.read_lines(spark, path)
    valid = C.valid_records(lines).collect()
    rej = C.rejects(lines).collect()
    return lines, valid, rej


def test_all_valid_first_record(spark, write_file):
    recs = [make_line(entity=f"0000{1 + i % 5}", situation=s) for i, s in enumerate(SITS)]
    path = write_file(["# registry header comment"] + recs)
    _, valid, rej = _split(spark, path)
    assert len(valid) == 10 and rej == []
    first = sorted(valid, key=lambda r: r.row_id)[0]
    assert (first.entity_code, first.info_date, first.identification_type,
            first.identification_number, first.activity, first.situation) == (
        "00001", "202601", "11", "20345123458", "001", "01")
    assert first.loans == Decimal("1500.50") and first.unused == Decimal("0.00")
    assert first.guarantees == Decimal("500.00") and first.other_concepts == Decimal("100.00")
    assert first.days_overdue == 0


def test_edge_cases_blank_comment_short(spark, write_file):
    path = write_file(["# c", "", "short line", make_line(), "", make_line(situation="05")])
    _, valid, rej = _split(spark, path)
    assert len(valid) == 2
    assert [(r.reason, r.detail) for r in rej] == [("short_line", "10")]


def test_bad_situations(spark, write_file):
    path = write_file(["# c"] + [make_line(situation=s) for s in ["01", "99", "03", "00", "05"]])
    _, valid, rej = _split(spark, path)
    assert sorted(r.situation for r in valid) == ["01", "03", "05"]
    assert sorted((r.reason, r.detail) for r in rej) == [("situation", "00"), ("situation", "99")]


def test_mixed_id_types(spark, write_file):
    path = write_file(["# c"] + [make_line(idtype=t) for t in ["11", "05", "11", "80", "11"]])
    _, valid, rej = _split(spark, path)
    assert len(valid) == 3
    assert sorted(r.detail for r in rej) == ["05", "80"]


def test_one_of_each_reject_in_order(spark, write_file):
    path = write_file([make_line(), "SHORT", make_line(idtype="99"),
                       make_line(situation="99"), make_line()])
    lines, valid, _ = _split(spark, path)
    got = RT.with_line_numbers(lines)
    rej = C.rejects(got).orderBy("line_number").collect()
    assert len(valid) == 2
    assert [(r.line_number, r.reason) for r in rej] == [
        (2, "short_line"), (3, "id_type"), (4, "situation")]


def test_short_line_wins_over_other_checks(spark, write_file):
    path = write_file([make_line(idtype="99")[:170]])
    _, _, rej = _split(spark, path)
    assert [r.reason for r in rej] == ["short_line"]


def test_single_digit_situations(spark, write_file):
    path = write_file([make_line(situation=f"{d} ") for d in "12345"])
    _, valid, rej = _split(spark, path)
    assert sorted(r.situation for r in valid) == sorted(["01", "21", "03", "04", "05"])
    assert rej == []


def test_latin1_byte_decoded_without_shift(spark, write_file):
    line = make_line(activity="ÑAB", days="0042")
    raw = line.encode("latin-1")
    assert b"\xd1" in raw and len(raw) == 171
    path = write_file([raw])
    _, valid, _ = _split(spark, path)
    assert valid[0].activity == "ÑAB" and valid[0].days_overdue == 42
    assert valid[0].situation == "01"


def test_crlf_line_ends(spark, write_file):
    path = write_file([make_line(), make_line()[:170]], terminator=b"\r\n")
    _, valid, rej = _split(spark, path)
    assert len(valid) == 1 and [r.detail for r in rej] == ["170"]


def test_longer_lines_accepted(spark, write_file):
    path = write_file([make_line() + "TAIL"])
    _, valid, _ = _split(spark, path)
    assert len(valid) == 1 and valid[0].days_overdue == 0


def test_identification_trimmed(spark, write_file):
    path = write_file([make_line(ident=" 203451234 ")])
    _, valid, _ = _split(spark, path)
    assert valid[0].identification_number == "203451234"


def test_line_numbers_across_many_splits_and_files(spark, tmp_path):
    """Per-file numbering with files cut into many splits equals enumerate()."""
    d = tmp_path / "multi"
    d.mkdir()
    expected = []
    for f in range(3):
        rows = [f"file{f} line {i:06d} " + "x" * (i % 40) for i in range(1, 4001 + 997 * f)]
        rows[10] = ""  # blank lines count too
        (d / f"part{f}.txt").write_bytes(("\n".join(rows) + "\n").encode("latin-1"))
        expected += [(i + 1, r) for i, r in enumerate(rows)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        lines = RT.read_lines(spark, str(d))
        assert lines.select("source_file", "split_start").distinct().count() > 10
        got = RT.with_line_numbers(lines).select("line_number", "line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.line_number, r.line) for r in got) == sorted(expected)


def test_classification_needs_no_python(spark, write_file):
    path = write_file([make_line()])
    plan = C.valid_records(RT.read_lines(spark, path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_reject_counts(spark, write_file):
    path = write_file([make_line(), "x", make_line(idtype="01"), make_line(idtype="01")])
    got = {r.reason: r.n_lines for r in C.reject_counts(RT.read_lines(spark, path)).collect()}
    assert got == {"short_line": 1, "id_type": 2}


def test_writer_roundtrip(spark, write_file, tmp_path):
    amounts = ["0000001500,5", "000000000001", "00000000,125", "-00000000017"] + ["000000000000"] * 7
    src = make_line(activity="ÑAB", loans=amounts[0], unused=amounts[1], guarantees=amounts[2],
                    other=amounts[3], days="0007")
    recs = C.valid_records(RT.read_lines(spark, write_file([src]))).select(
        *[n for n in C.L.FIELD_NAMES])
    out = str(tmp_path / "written")
    RT.write_fixed_width(recs, out)
    back = C.valid_records(RT.read_lines(spark, out)).select(*C.L.FIELD_NAMES).collect()
    assert [tuple(r) for r in back] == [tuple(r) for r in recs.collect()]
    raw = [ln for ln in RT.read_lines(spark, out).select(F.length("line")).collect()]
    assert raw[0][0] == 171


def test_compressed_files_are_bounded_and_read_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(RT, "COMPRESSED_FILE_LINES", 30)
    values = {"amount": F.lit("-12.34").cast("decimal(18,2)"), "int": F.col("id").cast("int")}
    recs = spark.range(0, 100, 1, 1).select(*[
        values.get(kind, F.lit("\u00d1" if name == "activity" else "1")).alias(name)
        for name, _, _, kind in L.FIELDS])
    plain, small = str(tmp_path / "plain"), str(tmp_path / "small")
    RT.write_fixed_width(recs, plain)
    RT.write_fixed_width(recs, small, compressed=True)
    files = glob.glob(f"{small}/part-*")
    assert all(f.endswith(".txt.gz") for f in files)
    back = RT.read_lines(spark, small)
    assert sorted(r[0] for r in back.groupBy("source_file").count().select("count").collect()) == [
        10, 30, 30, 30]
    for part in ("line", "raw"):
        assert sorted(back.select(part).collect()) == sorted(
            RT.read_lines(spark, plain).select(part).collect())
    assert sum(map(os.path.getsize, files)) * 2 < sum(
        map(os.path.getsize, glob.glob(f"{plain}/part-*")))


def test_roundtrip_keeps_its_second_text_small(spark, write_file, monkeypatch):
    """The written text stays until the result is read, beside the registry itself."""
    path = write_file([make_line(entity=f"{i:05d}", ident=f"2034{i:07d}") for i in range(2000)])
    written = []
    monkeypatch.setattr(D, "registry", lambda *_: path)
    write = RT.write_fixed_width
    monkeypatch.setattr(RT, "write_fixed_width", lambda recs, out, *a, **k: (
        written.append(out), write(recs, out, *a, **k)))
    back = D.QUERIES["roundtrip"](spark, "").collect()
    assert sorted(back) == sorted(
        C.valid_records(RT.read_lines(spark, path)).select(*L.FIELD_NAMES).collect())
    assert len(back) == 2000
    assert sum(map(os.path.getsize, glob.glob(f"{written[0]}/part-*"))) * 2 < os.path.getsize(path)


def test_line_numbers_survive_a_layout_change(spark, tmp_path):
    """Numbering stays exact when the scan layout changes between planning
    the numbering and running it (as when executors come and go)."""
    p = tmp_path / "one.txt"
    rows = [f"row {i:05d}" for i in range(1, 3001)]
    p.write_bytes(("\n".join(rows) + "\n").encode("latin-1"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        numbered = RT.with_line_numbers(RT.read_lines(spark, str(p)))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7k")   # layout changes
        got = numbered.select("line_number", "line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.line_number, r.line) for r in got) == [(i + 1, r) for i, r in enumerate(rows)]


def test_written_amounts_are_formatted_once(spark, tmp_path):
    """The written lines are those of the plain expression, and an amount's digits
    are made once: the later steps only read them."""
    values = [Decimal(v) for v in ("0", "-0.01", "0.10", "1500.50", "-12.34", "99999999.99",
                                   "-7.00", "10.05", "123456789.1")]
    rows = [tuple(values[(i + j) % 9] if kind == "amount" else 7 if kind == "int"
                  else "1" for j, (_, _, _, kind) in enumerate(L.FIELDS)) for i in range(9)]
    schema = ", ".join(f"{n} " + {"amount": "decimal(18,2)", "int": "int"}.get(k, "string")
                       for n, _, _, k in L.FIELDS)
    recs = spark.createDataFrame(rows, schema).coalesce(1)
    RT.write_fixed_width(recs, str(tmp_path / "w"))
    got = sorted(r[0] for r in spark.read.text(str(tmp_path / "w")).collect())
    want = sorted(r[0] for r in recs.select(RT.render_line()).collect())
    assert got == want and any("-00000012,34" in x for x in got)
    step = RT.amount_text(F.col("loans"), RT.amount_body(F.col("d")))
    assert "abs" not in str(step) and str(RT.amount_digits(F.col("loans"))).count("abs") == 1
