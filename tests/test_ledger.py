"""A backend that counts its calls and dies half-way is asked once for each text."""

import collections
import pathlib
import time

import pytest

from graphquarry.operators import enrich
from graphquarry.operators.ledger import Ledger


def counting(folder, dies_at=None):
    """A backend that notes each text, and fails at one while a mark stands in the folder."""

    def backend(texts):
        if dies_at in texts and (pathlib.Path(folder) / "dies").exists():
            raise RuntimeError("lost")
        with open(f"{folder}/asked", "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return [None if t == "t3" else f"about {t}" for t in texts]

    return backend


def asked(folder):
    return collections.Counter((pathlib.Path(folder) / "asked").read_text().split("\n")[:-1])


def test_work_is_taken_up_where_a_run_broke_off(spark, tmp_path):
    work = spark.createDataFrame([(f"{k:03d}", f"t{k}") for k in range(200)] + [("none", None)], "id string, text string")
    ledger = Ledger(spark, f"file://{tmp_path}/ledger", batch=10, claimed=8, concurrency=3, expiry=3.0)
    (tmp_path / "dies").touch()
    backend = counting(str(tmp_path), "t120")
    with pytest.raises(Exception, match="lost"):
        ledger.ask(work, backend)
    first = asked(tmp_path)
    assert 0 < len(ledger.answered()) < 21 and set(first.values()) == {1}
    (tmp_path / "dies").unlink()
    time.sleep(3.1)  # the claims of the run that broke off end
    got = {r["id"]: r["value"] for r in ledger.ask(work, backend).collect()}  # a new driver
    assert got == {f"{k:03d}": None if k == 3 else f"about t{k}" for k in range(200)} | {"none": "about "}
    assert set(asked(tmp_path).values()) == {1}
    assert ledger.ask(work.limit(3), backend).count() == 201 and set(asked(tmp_path).values()) == {1}


def test_claims_hold_for_a_time(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger", claimed=2, expiry=3600)
    assert ledger.claim([1, 2, 3], "a") == [1, 2] and ledger.claim([1, 2, 3], "b") == [3] and ledger.claim([1, 2, 3], "c") == []
    late = Ledger(spark, f"file://{tmp_path}/late", expiry=1.0)
    assert late.claim([1], "a") == [1] and late.claim([1], "b") == []
    time.sleep(1.2)
    assert late.claim([1], "b") == [1]


def test_no_work(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    assert ledger.ask(spark.createDataFrame([], "id string, text string"), counting(str(tmp_path))).count() == 0


def test_levels_through_a_ledger(spark, tmp_path):
    nodes = spark.createDataFrame([("f", "Function", "f", "p::f", "code", None, None), ("g", "File", "g", "p", "code", None, None)], "id string, label string, name string, full_name string, raw_code string, generated_summary string, summary_status string")
    edges = spark.createDataFrame([("g", "f", "CONTAINS")], "src string, dst string, type string")

    def backend(texts):
        with open(f"{tmp_path}/asked", "a") as f:
            f.write("x\n" * len(texts))
        return [f"{len(t)} characters" for t in texts]

    answers = lambda label, work: Ledger(spark, f"file://{tmp_path}/{label}").ask(work, backend)
    for _ in range(2):  # the second run asks nothing
        got = {r["id"]: r["generated_summary"] for r in enrich.summarise_levels(nodes, edges, answers=answers).collect()}
        assert all(v.endswith("characters") for v in got.values()) and asked(tmp_path) == {"x": 2}
