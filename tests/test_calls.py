"""Calls of a provider through a ledger: a prompt is asked once, whatever tasks die or branches share it."""

import os
import subprocess
import sys
import textwrap
from collections import Counter

import pytest

from attestor.operators import model
from attestor.sources.calls import CallLedger, _Notes
from attestor.sources.shared import folder

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def asked(path):
    return Counter(open(path).read().split("\n")[:-1]) if os.path.exists(path) else Counter()


def provider(log, kill_at=None):
    """Notes each call; ends the whole process before the call of that number, once."""

    def call(prompt):
        name = prompt.split("Measurement: ")[1].split("\n")[0]
        if kill_at is not None and not os.path.exists(f"{log}.killed") and sum(asked(log).values()) >= kill_at:
            open(f"{log}.killed", "w").close()
            os._exit(9)
        with open(log, "a") as f:
            f.write(name + "\n")
        if name == "fails":
            raise RuntimeError("no answer")
        return model.Answer('{"status": "insufficient"}', 1, 2)

    return call


def questions(spark, names):
    return spark.createDataFrame([(n, f"{n} is stated here") for n in names], "attribute_name string, passage string")


def test_each_prompt_is_asked_once(spark, tmp_path):
    log, ledger = str(tmp_path / "log"), CallLedger(spark, folder(spark, "calls"))
    names = [f"a{i}" for i in range(30)] + ["a0", "a0", "fails"]
    for own in (names, names + ["later"]):
        found = model.by_model(provider(log), ledger=ledger)(questions(spark, own))
        both = found.unionByName(found).collect()  # two branches of one plan
        assert len(both) == 2 * len(own) and {r.x.status for r in both if r.attribute_name != "fails"} == {"insufficient"}
        assert [(r.x.status, r.x.error_type) for r in both if r.attribute_name == "fails"] == [("error", model.PROVIDER_ERROR)] * 2
    assert asked(log) == Counter({*names, "later"})
    again = model.by_model(provider(log), ledger=CallLedger(spark, ledger.path, again=True))(questions(spark, names))
    assert again.count() == len(names) and asked(log) - Counter({*names, "later"}) == Counter(["fails"])
    other = model.by_model(provider(log), model="other", ledger=ledger)(questions(spark, ["a0", None])).collect()
    assert asked(log)["a0"] == 2 and len(other) == 2  # another model is asked by itself, and a question without a prompt isn't asked


def test_a_killed_task_goes_on_from_the_ledger(tmp_path):
    """The worker dies between two calls; Spark runs the task again, and no prompt is asked twice."""
    log = str(tmp_path / "log")
    code = f"""
        import sys
        sys.path[:0] = [{ROOT!r}, {os.path.join(ROOT, "tests")!r}]
        from pyspark.sql import SparkSession
        from attestor.operators import model
        from attestor.sources.calls import CallLedger
        from test_calls import provider, questions
        spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
        names = ["a%d" % i for i in range(40)]
        found = model.by_model(provider({log!r}, kill_at=15), ledger=CallLedger(spark, "file://{tmp_path}/ledger", patience=1.0))(questions(spark, names))
        assert found.count() == 40
    """
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([ROOT, os.path.join(ROOT, "tests")])}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert os.path.exists(f"{log}.killed") and asked(log) == Counter(f"a{i}" for i in range(40))


def test_notes_of_two_attempts(tmp_path):
    """An attempt waits for another's answer, and takes over from one that is gone."""
    notes = _Notes(f"file://{tmp_path}", 0.2)
    assert notes.claim("abc") and not notes.claim("abc")
    assert notes.once("abc", lambda: {"text": "taken over"}) == {"text": "taken over"}
    assert notes.once("abc", lambda: pytest.fail("asked twice")) == {"text": "taken over"}


def test_bounds_of_a_call():
    import time

    tries = []

    def slow(_):
        tries.append(1)
        time.sleep(0.5)

    assert model.attempt(slow, "x", timeout=0.05)["failed"].startswith("TimeoutError") and len(tries) == 1
    assert model.attempt(lambda p: 1 / 0, "x", attempts=3)["failed"].startswith("ZeroDivisionError")
    said = iter([ValueError("once")])

    def second(_):
        for e in said:
            raise e
        return model.Answer("fine")

    assert model.attempt(second, "x", attempts=2)["text"] == "fine"
