from __future__ import annotations

import csv
import random
from datetime import date
from decimal import Decimal, InvalidOperation

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixtures import rows_of
from tallymart.functions import try_typed
from tallymart.schemas import MANDATORY_COLUMNS, SALES
from tallymart.sources import csv_files as cf

HEADER = ",".join(MANDATORY_COLUMNS)
LINE = "1,121,sugar,2023-03-03,1,50,2,100"


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return path


def manifest_of(spark, folder):
    listing = cf.list_files(spark, str(folder)).unionByName(cf.empty_files(spark, str(folder)))
    return cf.check_headers(listing, cf.probe_headers(spark, str(folder)))


def verdicts(spark, folder):
    return {r.file_name: r for r in manifest_of(spark, folder).collect()}


def load(spark, folder):
    return cf.read_sales(spark, manifest_of(spark, folder))


def test_listing_sees_nested_files_and_skips_hidden_ones(spark, tmp_path):
    put(tmp_path, "a.csv", "x")
    put(tmp_path, "deep/er/b.txt", "xy")
    put(tmp_path, "_SUCCESS", "")
    listing = cf.list_files(spark, str(tmp_path))
    assert rows_of(cf.with_file_type(listing), "file_name", "length", "is_csv") == [
        ("a.csv", 1, True), ("b.txt", 2, False),
    ]


def test_empty_folder_is_an_error(spark, tmp_path):
    with pytest.raises(cf.NoInputError):
        cf.require_files(cf.list_files(spark, str(tmp_path)), "files")


def test_verdict_on_each_kind_of_file(spark, tmp_path):
    put(tmp_path, "usual.csv", f"{HEADER}\n{LINE}\n")
    put(tmp_path, "with space+plus%.csv", f"{HEADER}\r\n{LINE}\r\n")
    put(tmp_path, "blank first.csv", f"\n  \n{HEADER}\n{LINE}\n")
    put(tmp_path, "extra.csv", f'{HEADER},payment_mode,"note, long"\n{LINE},cash,"a ""b"", c"\n')
    put(tmp_path, "short.csv", "customer_id,product_name,sales_date,sales_person_id,price,quantity,total_cost\n")
    put(tmp_path, "twice.csv", f"{HEADER},price\n{LINE},1\n")
    put(tmp_path, "bom.csv", f"﻿{HEADER}\n{LINE}\n")
    put(tmp_path, "header only.csv", f"{HEADER}\n")
    put(tmp_path, "zero.csv", "")
    put(tmp_path, "note.txt", f"{HEADER}\n")
    found = verdicts(spark, tmp_path)
    assert {name: r.reason for name, r in found.items()} == {
        "usual.csv": None,
        "with space+plus%.csv": None,
        "blank first.csv": None,
        "extra.csv": None,
        "short.csv": cf.MISSING_COLUMNS,
        "twice.csv": cf.REPEATED_COLUMNS,
        "bom.csv": None,
        "header only.csv": None,
        "zero.csv": cf.NO_HEADER,
        "note.txt": cf.NOT_CSV,
    }
    assert found["short.csv"].missing == ["store_id"]
    assert found["extra.csv"].extra == ["payment_mode", "note, long"]
    loaded = cf.good_rows(load(spark, tmp_path))
    assert loaded.columns == SALES.fieldNames()
    assert [f.dataType for f in loaded.schema] == [f.dataType for f in SALES]
    assert rows_of(loaded, "additional_columns") == sorted([(None,)] * 4 + [('cash, a "b", c',)], key=repr)


def test_header_of_a_file_in_many_splits(spark, tmp_path):
    put(tmp_path, "big.csv", HEADER + "\n" + (LINE + "\n") * 5_000)
    put(tmp_path, "other.csv", ",".join(reversed(MANDATORY_COLUMNS)) + "\n" + "100,2,50,1,2023-03-03,sugar,121,1\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert {n: r.reason for n, r in verdicts(spark, tmp_path).items()} == {"big.csv": None, "other.csv": None}
        loaded = cf.good_rows(load(spark, tmp_path))
        assert loaded.count() == 5_001
        assert loaded.distinct().count() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_cells_that_do_not_parse_reject_their_row_only(spark, tmp_path):
    put(
        tmp_path,
        "a.csv",
        f"{HEADER}\n{LINE}\nx,121,sugar,2023-03-03,1,50,2,100\n1,121,sugar,03/03/2023,1,50,two,100\n"
        "1,,sugar,,1,50,2,\n",
    )
    sales = load(spark, tmp_path)
    assert rows_of(cf.bad_rows(sales)) == sorted(
        [
            ("x,121,sugar,2023-03-03,1,50,2,100", ["customer_id"]),
            ("1,121,sugar,03/03/2023,1,50,two,100", ["sales_date", "quantity"]),
        ],
        key=repr,
    )
    good = cf.good_rows(sales)
    assert good.count() == 2
    assert good.where("total_cost is null").first().store_id is None
    assert good.where("total_cost is not null").first().total_cost == Decimal("100.00")


def test_one_scan_per_layout(spark, tmp_path):
    for i in range(12):
        put(tmp_path, f"u{i}.csv", f"{HEADER}\n{LINE}\n")
        put(tmp_path, f"e{i}.csv", f"{HEADER},payment_mode\n{LINE},UPI\n")
    sales = load(spark, tmp_path)
    plan = sales._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2
    assert sales.count() == 24


def test_no_usable_file_gives_an_empty_typed_frame(spark, tmp_path):
    put(tmp_path, "a.txt", "x")
    sales = load(spark, tmp_path)
    assert cf.good_rows(sales).schema.fieldNames() == SALES.fieldNames()
    assert sales.isEmpty()


def test_file_names_are_not_patterns(spark, tmp_path):
    put(tmp_path, "sales[1]{a,b}.csv", f"{HEADER}\n{LINE}\n")
    listing = cf.list_files(spark, str(tmp_path))
    paths = [r.path for r in listing.collect()]
    manifest = cf.check_headers(listing, cf.probe_headers(spark, paths))
    assert cf.read_sales(spark, manifest).count() == 1


def parsed(column, text):
    """What a cell should become: its value, None for an empty cell, ValueError for bad text."""
    if text == "":
        return None
    if column == "product_name":
        return text
    try:
        if column == "sales_date":
            return date.fromisoformat(text)
        if column in ("price", "total_cost"):
            return Decimal(text).quantize(Decimal("0.01"))
        return int(text)
    except InvalidOperation as error:
        raise ValueError(text) from error


@pytest.mark.parametrize("seed", [1, 2])
def test_random_files_against_plain_python(spark, tmp_path, seed):
    rnd = random.Random(seed)
    cells = {
        "customer_id": ["1", "20", "", "x", "[1, 2]"],
        "store_id": ["121", "", "12.5"],
        "product_name": ["sugar", 'say "hi"', "a, b", ""],
        "sales_date": ["2023-03-03", "2024-02-29", "", "2023-02-30", "03/03/2023"],
        "sales_person_id": ["1", "9", "?"],
        "price": ["1.5", "212", "", "free"],
        "quantity": ["3", "", "three"],
        "total_cost": ["4.50", "636", "", "1,000"],
    }
    extras = ["payment_mode", "note, long", "city"]
    good, bad, reasons = [], 0, {}
    for i in range(12):
        columns = list(cells)
        rnd.shuffle(columns)
        dropped = columns.pop() if i % 6 == 5 else None
        for extra in rnd.sample(extras, rnd.randrange(3)):
            columns.insert(rnd.randrange(len(columns) + 1), extra)
        name = f"f{i}.csv"
        reasons[name] = cf.MISSING_COLUMNS if dropped else None
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as file:
            out = csv.writer(file)
            out.writerow(columns)
            for _ in range(rnd.randrange(6)):
                row = {c: rnd.choice(cells[c] if c in cells else ["cash", "u, v", ""]) for c in columns}
                written = [row[c] for c in columns]
                cut = rnd.randrange(8)
                if cut == 0:
                    written = written[:-1]
                elif cut == 1:
                    written = [*written, "more"]
                out.writerow(written)
                if dropped:
                    continue
                if cut < 2:
                    bad += 1
                    continue
                try:
                    values = [parsed(c, row[c]) for c in MANDATORY_COLUMNS]
                except ValueError:
                    bad += 1
                    continue
                extra_cells = [row[c] for c in columns if c not in cells]
                packed = ", ".join(c for c in extra_cells if c) if extra_cells else None
                good.append((*values, packed))
    assert {n: r.reason for n, r in verdicts(spark, tmp_path).items()} == reasons
    sales = load(spark, tmp_path)
    assert rows_of(cf.good_rows(sales)) == sorted(good, key=repr)
    assert cf.bad_rows(sales).count() == bad


def test_ragged_rows_and_lossy_cells_are_rejected_whole(spark, tmp_path):
    lines = [
        "1,121,sugar",
        "1,121,sugar,2023-03-03,1,50,2,100,more,still",
        "1,121,salt, fine,2023-03-03,1,50,2,100",
        "1,121,sugar,2023-03,1,50,2,12.345",
    ]
    put(tmp_path, "a.csv", "\n".join([HEADER, LINE, *lines, "1,121,sugar,2023-03-03,1,50,2,12.3400"]) + "\n")
    sales = load(spark, tmp_path)
    assert rows_of(cf.bad_rows(sales)) == sorted(
        [(lines[0], ["row"]), (lines[1], ["row"]), (lines[2], ["row"]), (lines[3], ["sales_date", "total_cost"])], key=repr
    )
    assert rows_of(cf.good_rows(sales), "total_cost") == [(Decimal("100.00"),), (Decimal("12.34"),)]


ODD_FILES = {
    "plain.csv": "customer_id,store_id,product_name,sales_date,sales_person_id,price,quantity,total_cost\n1,2,x,2023-01-01,3,4,5,6.00\n",
    "bom.csv": "﻿customer_id,store_id,product_name,sales_date,sales_person_id,price,quantity,total_cost\r\n1,2,x,2023-01-01,3,4,5,6.00\r\n\r\n",
    "quoted.csv": '\n \n"store_id","customer_id",product_name,sales_date,sales_person_id,price,quantity,total_cost,"a, ""b"""\n2,1,"x, ""y""",2023-01-01,3,4,5,6,"e,1"\n2,1,,,,,,,\n',
    "ragged.csv": "customer_id,store_id,product_name,sales_date,sales_person_id,price,quantity,total_cost\n1,2\n\n1,2,x,2023-01-01,3,4,5,6,7\n1,2,x,2023-01-01,3,4,5,six",
    "head only.csv": "customer_id,store_id,product_name,sales_date,sales_person_id,price,quantity,total_cost",
    "twice.csv": "customer_id,store_id,product_name,sales_date,sales_person_id,price,quantity,total_cost\ncustomer_id,store_id,product_name,sales_date,sales_person_id,price,quantity,total_cost\n",
    "short.csv": "customer_id\n1\n",
    "sub/a+b%20[x].csv": "total_cost,quantity,price,sales_person_id,sales_date,product_name,store_id,customer_id\n6,5,4,3,2023-01-01,x y,2,1\n" * 1,
}


def test_staged_lines_give_the_same_headers_and_rows(spark, tmp_path):
    for name, text in ODD_FILES.items():
        path = tmp_path / "landing" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    landing = str(tmp_path / "landing")
    cf.stage_lines(spark, landing).write.parquet(str(tmp_path / "lines"))
    lines = spark.read.parquet(str(tmp_path / "lines"))
    listing = cf.list_files(spark, landing)
    held = {}
    for name, headers in (("probed", cf.probe_headers(spark, landing)), ("staged", cf.staged_headers(lines))):
        cf.check_headers(listing, headers).write.parquet(str(tmp_path / name))
        held[name] = spark.read.parquet(str(tmp_path / name))
    columns = ["uri", "header", "columns", "missing", "extra", "reason"]
    assert rows_of(held["staged"], *columns) == rows_of(held["probed"], *columns)
    from_files, from_lines = cf.read_sales(spark, held["probed"]), cf.read_sales(spark, held["staged"], lines)
    assert rows_of(from_lines, *sorted(from_lines.columns)) == rows_of(from_files, *sorted(from_files.columns))
    assert from_lines.count() == 9 and cf.bad_rows(from_lines).count() == 4
    plan = from_lines._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "FileScan csv" not in plan and "FileScan text" not in plan


def test_a_file_of_many_blocks_has_one_header(spark, tmp_path):
    header = "customer_id,store_id,product_name,sales_date,sales_person_id,price,quantity,total_cost\n"
    (tmp_path / "landing").mkdir()
    (tmp_path / "landing" / "large.csv").write_text(header + "".join(f"{i},2,x,2023-01-01,3,4,5,6.00\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        cf.stage_lines(spark, str(tmp_path / "landing")).write.parquet(str(tmp_path / "lines"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    lines = spark.read.parquet(str(tmp_path / "lines"))
    assert lines.select("block_start").distinct().count() > 5
    cf.check_headers(cf.list_files(spark, str(tmp_path / "landing")), cf.staged_headers(lines)).write.parquet(str(tmp_path / "files"))
    rows = cf.good_rows(cf.read_sales(spark, spark.read.parquet(str(tmp_path / "files")), lines))
    assert sorted(r.customer_id for r in rows.collect()) == list(range(5000))


def test_staged_lines_are_parsed_once(spark, tmp_path):
    """A filter on the cells must not parse the line anew for each cell."""
    put(tmp_path, "landing/a.csv", f"{HEADER}\n{LINE}\n")
    cf.stage_lines(spark, str(tmp_path / "landing")).write.parquet(str(tmp_path / "lines"))
    lines = spark.read.parquet(str(tmp_path / "lines"))
    manifest = cf.check_headers(cf.list_files(spark, str(tmp_path / "landing")), cf.staged_headers(lines))
    rows = cf.good_rows(cf.read_sales(spark, manifest, lines))
    assert rows.count() == 1
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_csv") == 1


def test_headers_are_found_without_shuffling_lines(spark, tmp_path):
    put(tmp_path, "landing/a.csv", f"{HEADER}\n{LINE}\n")
    cf.stage_lines(spark, str(tmp_path / "landing")).write.parquet(str(tmp_path / "lines"))
    plan = cf.staged_headers(spark.read.parquet(str(tmp_path / "lines")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_lines_cut_at_commas_equal_parsed_ones(spark, tmp_path):
    """Every odd line gives the cells that a CSV scan of it gives."""
    odd = [
        "a,b,c", ",,", "a,,", ",,c", " a , b ,c ", "a,b", "a,b,c,d", "a,b,c,", "x", '"a,1",b,c', '"",b,c', 'a"x,b,c', '"a""x",b,c',
        "#a,b,c", "é,ü,ß", "a\tb,c,d", "a\\,b,c", "null,NULL,NaN", '"a,b,c', "a,b,\u00a0", "-,+,.", "\ufeffa,b,c", "'a',b,c", "\u0000a,b,c",
    ]
    (tmp_path / "odd.csv").write_text("\n".join(odd) + "\n", encoding="utf-8")
    scanned = cf.read_layout(spark, [str(tmp_path / "odd.csv")], ["p", "q", "r"], header=False).drop("source_file")
    staged = cf.parse_layout(cf.stage_lines(spark, str(tmp_path)), ["p", "q", "r"]).drop("source_file")
    # Of a ragged line only its text counts.
    shown = lambda df: rows_of(df.selectExpr("_ragged_line", *[f"if(_ragged_line is null, _c{i}, null)" for i in range(3)]))
    assert shown(staged) == shown(scanned)


def test_each_cell_is_typed_once(spark, tmp_path):
    """Checks name the typed cells; else a bad cell would be cast again, and fail with an exception, for each of them."""
    put(tmp_path, "landing/a.csv", f"{HEADER}\n{LINE}\n")
    cf.stage_lines(spark, str(tmp_path / "landing")).write.parquet(str(tmp_path / "lines"))
    lines = spark.read.parquet(str(tmp_path / "lines"))
    manifest = cf.check_headers(cf.list_files(spark, str(tmp_path / "landing")), cf.staged_headers(lines))
    plan = cf.read_sales(spark, manifest, lines)._jdf.queryExecution().optimizedPlan().toString()
    typed = sum(SALES[c].dataType.typeName() != "string" for c in MANDATORY_COLUMNS)
    assert plan.count("try_cast(") == typed == 7 and plan.count("RLIKE(") == 3


@pytest.mark.parametrize("kind", ["int", "bigint"])
def test_whole_numbers_are_those_that_the_cast_takes(spark, kind):
    texts = [
        "1", "-1", "+7", "007", " 5 ", "\t5", "5\r", "\x005\x1f", "5\x7f", "1 2", "12 pcs", "pcs", "", " ", "+", "-", "--1", "1-", "1.", "1.0", ".5", "1e3",
        "0x1", "1_000", "1,000", " 5", "٥", "2147483647", "2147483648", "-2147483648", "9223372036854775807", "9223372036854775808", "[1]", "NaN", None,
    ]
    kinds = {"int": T.IntegerType(), "bigint": T.LongType()}
    cells = spark.createDataFrame([(t,) for t in texts], "cell string")
    rows = cells.select("cell", try_typed(F.col("cell"), kinds[kind]).alias("typed"), F.trim("cell").try_cast(kind).alias("cast")).collect()
    assert [(r.cell, r.typed) for r in rows] == [(r.cell, r.cast) for r in rows]
    assert sum(r.typed is not None for r in rows) >= 9
