"""Bad rows of a typed load are kept aside and counted; good rows are unchanged."""

import pytest

from ebbflow.sources import readers, schemas
from ebbflow.sources.quarantine import TooManyBadRows, load_checked

GOOD = ["C+1/=,41,30,149,149,1,20170101,20170131,0", "C+2/=,41,30,,149,0,20170102,20170201,1", "C+1/=,41,30,149,149,1,20170101,20170131,0"]
BAD = ["C+3/=,41,thirty,149,149,1,20170101,20170131,0",        # not a number
       "C+4/=,41,30,149,149,300,20170101,20170131,0",          # outside its type
       "C+5/=,41,30,149",                                      # columns missing
       "C+6/=,41,30,149,149,1,20170101,20170131,0,extra"]      # too many


def _csv(folder, lines):
    folder.mkdir()
    header = ",".join(f.name for f in schemas.TRANSACTIONS)
    (folder / "part.csv").write_text("\n".join([header, *lines]) + "\n")
    return str(folder)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_bad_rows_are_kept_aside_and_counted(spark, tmp_path):
    path, aside = _csv(tmp_path / "in", [BAD[0], GOOD[0], BAD[1], *GOOD[1:], *BAD[2:]]), str(tmp_path / "bad")
    good = load_checked(spark, path, schemas.TRANSACTIONS, "t", aside, allowed_share=0.6, root=str(tmp_path / "s"))
    clean = readers.read_transactions(spark, _csv(tmp_path / "clean", GOOD))
    assert good.schema.fieldNames() == schemas.TRANSACTIONS.fieldNames() and _rows(good) == _rows(clean)
    assert sorted(r[0] for r in spark.read.text(aside).collect()) == sorted(BAD)
    assert good.select("msno").count() == len(GOOD)  # a pruned read has the same rows


def test_too_many_bad_rows_fail_the_load(spark, tmp_path):
    path, aside = _csv(tmp_path / "in", [*GOOD, BAD[0]]), str(tmp_path / "bad")
    with pytest.raises(TooManyBadRows, match="1 of 4 rows") as e:
        load_checked(spark, path, schemas.TRANSACTIONS, "t", aside, root=str(tmp_path / "s"))
    assert e.value.bad == 1 and [r[0] for r in spark.read.text(aside).collect()] == BAD[:1]


def test_clean_and_empty_files(spark, tmp_path):
    clean = load_checked(spark, _csv(tmp_path / "a", GOOD), schemas.TRANSACTIONS, "a", str(tmp_path / "x"), root=str(tmp_path / "s"))
    assert clean.count() == 3 and not (tmp_path / "x").exists()
    empty = load_checked(spark, _csv(tmp_path / "b", []), schemas.TRANSACTIONS, "b", str(tmp_path / "x"), root=str(tmp_path / "s"))
    assert empty.count() == 0
