"""Loads that read only what is new, versions, leases and ages."""

import json
import os
import threading

import pytest

from workpulse import labels as L
from workpulse.files import Store, Taken
from workpulse.snapshots import Conflict, Draft, Snapshots
from workpulse.sources import loads, records

from test_landings import END, case, land


def shown(rows):
    names = sorted(set(rows.columns) - set(records.PLACE) - {records.REST})
    return sorted(tuple(str(r[n]) for n in names) for r in rows.collect())


def asked(version):
    return loads.loaded(version, L.CASE_PROCESS, L.REQUESTED_STATUS)


@pytest.fixture
def pages(tmp_path):
    folder = tmp_path / "landed pages"  # a name with a blank, which one of Spark's names of a file has encoded
    folder.mkdir()
    land(folder, "a.json", [case("1", unidade="old"), case("2"), case(None), case("3", "FINALIZED", END)], 1000)
    land(folder, "b.json", [case(str(n)) for n in range(10, 40)], 1500)
    return folder


def test_a_second_load_reads_only_new_files(spark, tmp_path, pages, monkeypatch):
    root = str(tmp_path / "table")
    first = loads.load(spark, str(pages), root, buckets=8)
    assert (first.number, first.facts["files_read"]) == (1, 2)
    assert shown(asked(first)) == shown(records.read_cases(spark, str(pages)))

    land(pages, "c.json", [case("1", "FINALIZED", END, unidade="new", novoCampo="x"), case("2", "CANCELLED"), case(None)], 2000)
    given, read = [], records.read_records
    monkeypatch.setattr(records, "read_records", lambda spark, paths, *rest, **more: (given.extend(paths), read(spark, paths, *rest, **more))[1])
    second = loads.load(spark, str(pages), root)
    assert [os.path.basename(path) for path in given] == ["c.json"]
    assert second.number == 2 and second.facts["files_read"] == 1 and second.facts["buckets_written"] <= 3
    files = {r.processInstanceId: os.path.basename(r.landedFile) for r in loads.loaded(second).where("processInstanceId is not null").collect()}
    assert {number for number, file in files.items() if file == "c.json"} == {"1", "2"} and files["10"] == "b.json"
    monkeypatch.undo()
    assert shown(asked(second)) == shown(records.read_cases(spark, str(pages)))
    assert {r.processInstanceId: r.otherFields for r in asked(second).collect()}["1"] == {"novoCampo": "x"}
    # Buckets without one of the new cases lie where they lay.
    lying = [set(v.facts["tables"][loads.CASES]["parts"]) for v in (first, second)]
    assert len(lying[0] & lying[1]) >= len(lying[0]) - 3


def test_without_a_new_file_nothing_is_published(spark, tmp_path, pages):
    root = str(tmp_path / "table")
    first = loads.load(spark, str(pages), root, buckets=4)
    assert loads.load(spark, str(pages), root).number == first.number == 1


def test_an_older_landing_that_comes_late_changes_nothing(spark, tmp_path, pages):
    root = str(tmp_path / "table")
    loads.load(spark, str(pages), root, buckets=4)
    land(pages, "late.json", [case("3", unidade="older"), case("41")], 500)
    second = loads.load(spark, str(pages), root)
    assert shown(asked(second)) == shown(records.read_cases(spark, str(pages)))
    assert {r.processInstanceId: r.status for r in asked(second).collect()}["3"] == "FINALIZED"


def test_a_changed_file_is_read_again(spark, tmp_path, pages):
    root = str(tmp_path / "table")
    loads.load(spark, str(pages), root, buckets=4)
    land(pages, "a.json", [case("1", unidade="changed"), case(None), case("2"), case("3", "FINALIZED", END)], 3000)
    second = loads.load(spark, str(pages), root)
    assert second.facts["files_read"] == 1
    assert shown(asked(second)) == shown(records.read_cases(spark, str(pages)))


def test_a_load_that_dies_leaves_the_table(spark, tmp_path, pages, monkeypatch):
    root = str(tmp_path / "table")
    first = loads.load(spark, str(pages), root, buckets=4)
    before = shown(loads.loaded(first))
    land(pages, "c.json", [case("1", "FINALIZED", END), case("50")], 2000)

    def killed(self):
        raise KeyboardInterrupt

    for moment in ("publish", "write"):
        with monkeypatch.context() as patch:
            patch.setattr(Draft, moment, killed if moment == "publish" else lambda self, *_: killed(self))
            with pytest.raises(KeyboardInterrupt):
                loads.load(spark, str(pages), root)
        current = Snapshots(spark, root).current()
        assert current.number == 1 and shown(loads.loaded(current)) == before
    again = loads.load(spark, str(pages), root)
    assert again.facts["files_read"] == 1 and shown(asked(again)) == shown(records.read_cases(spark, str(pages)))
    # What the dead loads left goes with a sweep.
    gone = Snapshots(spark, root, clock=lambda: 1e12).sweep(10)
    assert len(gone) >= 2 and shown(loads.loaded(again)) == shown(loads.loaded(Snapshots(spark, root).current()))


def test_many_small_loads_equal_one(spark, tmp_path):
    folder, root = tmp_path / "landed", str(tmp_path / "table")
    folder.mkdir()
    states = ["OPEN", "FINALIZED", "CANCELLED", "OPEN"]
    for k in range(5):
        land(folder, f"{k}.json", [case(str(n), states[(n + k) % 4], END if (n + k) % 4 == 1 else None, unidade=f"U{k}") for n in range(60) if (n * 7 + k) % 3], 1000 + k // 2)
        version = loads.load(spark, str(folder), root, buckets=8)
    assert version.number == 5
    assert shown(asked(version)) == shown(records.read_cases(spark, str(folder)))
    plan = loads._merged(loads._with_bucket(version.table(loads.CASES), 8), 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_buckets_of_many_rows_are_merged_in_slices(spark, tmp_path, monkeypatch):
    """No task gets a whole bucket, whatever the number of buckets; later loads find the slices' files."""
    monkeypatch.setattr(loads, "ROWS_A_TASK", 10)
    folder, root = tmp_path / "landed", str(tmp_path / "table")
    folder.mkdir()
    for k in range(3):
        land(folder, f"{k}.json", [case(str(n), unidade=f"U{k}") for n in range(0, 120, k + 1)] + [case(None)], 1000 + k)
        version = loads.load(spark, str(folder), root, buckets=2)
    assert shown(asked(version)) == shown(records.read_cases(spark, str(folder)))
    for part in version.facts["tables"][loads.CASES]["parts"]:
        held = [spark.read.parquet(os.path.join(root, part, name)) for name in os.listdir(os.path.join(root, part)) if name.startswith("part-")]
        assert len(held) > 2 and all(rows.count() < 40 for rows in held)
    plan = loads._merged(loads._with_bucket(version.table(loads.CASES), 2), 2, 6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "12), REPARTITION_BY_NUM" in plan


def test_whole_rows_are_grouped_only_if_a_case_is_there_twice(spark, tmp_path):
    def fresh(cases):
        folder = tmp_path / f"landed{len(cases)}"
        folder.mkdir()
        land(folder, "a.json", cases, 1000)
        return loads._with_bucket(loads._flat(records.read_records(spark, str(folder), placed=True), loads.CASE_PAGES, "raise"), 4)

    once, touched, rows = loads._once(fresh([case("1"), case("2"), case(None), case(None)]))
    assert rows == 4 and set(touched) == {r.bucket for r in once.collect()} and loads.ENDED not in once.columns
    assert "Aggregate" not in once._jdf.queryExecution().executedPlan().toString()
    twice, _, rows = loads._once(fresh([case("1"), case("1", "FINALIZED", END), case("2")]))
    assert rows == 3 and sorted((r.processInstanceId, r.status) for r in twice.collect()) == [("1", "FINALIZED"), ("2", "OPEN")]


def test_two_loads_at_once(spark, tmp_path, pages):
    root = str(tmp_path / "table")
    tables = Snapshots(spark, root)
    one, other = tables.begin(), tables.begin()
    for draft in (one, other):
        draft.write("t", spark.range(3))
    one.publish()
    with pytest.raises(Conflict):
        other.publish()
    assert tables.current().name == one.name


def test_lost_pages_are_told_and_an_empty_folder_is_a_table(spark, tmp_path):
    folder, root = tmp_path / "landed", str(tmp_path / "table")
    folder.mkdir()
    empty = loads.load(spark, str(folder), root, buckets=4)
    assert loads.loaded(empty).collect() == [] and empty.facts["files_read"] == 0
    (folder / "a.json").write_text('{"requests": [{"broken')
    with pytest.raises(Exception, match="broken page"):
        loads.load(spark, str(folder), root)
    assert Snapshots(spark, root).current().number == 1
    assert loads.load(spark, str(folder), root, on_lost="skip").number == 2


def test_payments(spark, tmp_path):
    folder, root = tmp_path / "landed", str(tmp_path / "table")
    folder.mkdir()
    land(folder, "a.json", [case("1", process=L.PAYMENT_PROCESS, tpPagamento="x")], 1000)
    version = loads.load(spark, str(folder), root, loads.PAYMENT_PAGES, buckets=2)
    assert shown(loads.loaded(version, L.PAYMENT_PROCESS, L.REQUESTED_STATUS)) == shown(records.read_payments(spark, str(folder)))


# ---- Versions ---------------------------------------------------------------------------------------------------------


class Clock:
    def __init__(self):
        self.now = 1000.0

    def __call__(self):
        return self.now


def test_kept_for_its_age(spark, tmp_path):
    clock, made = Clock(), []
    tables = Snapshots(spark, str(tmp_path / "t"), clock)

    def make(draft):
        made.append(draft.name)
        draft.write("report", spark.range(len(made)))

    first = tables.kept(600, make)
    clock.now += 599
    assert tables.kept(600, make).number == first.number and len(made) == 1  # the source is not read
    clock.now += 1
    second = tables.kept(600, make)
    assert second.number == 2 and second.table("report").count() == 2
    assert first.table("report").count() == 1  # readers of the old version go on


def test_sweep_keeps_what_is_in_use(spark, tmp_path):
    clock = Clock()
    tables = Snapshots(spark, str(tmp_path / "t"), clock)

    def publish(n):
        draft = tables.begin()
        draft.write("t", spark.range(n))
        return draft.publish()

    first = publish(1)
    with tables.leased(1000) as held:
        second = publish(2)
        draft = tables.begin()
        draft.note("t", second.table("t").schema, second.facts["tables"]["t"]["parts"])  # uses a folder of the second
        third = draft.publish()
        clock.now += 500
        assert tables.sweep(100) == [] and held.table("t").count() == 1
    assert tables.sweep(100) == [first.name]
    assert third.table("t").count() == 2 and tables.current().number == 3
    assert tables.store.names("leases") == []


def test_a_lease_of_a_dead_reader_ends(spark, tmp_path):
    clock = Clock()
    tables = Snapshots(spark, str(tmp_path / "t"), clock)
    for n in (1, 2):
        draft = tables.begin()
        draft.write("t", spark.range(n))
        version = draft.publish()
        if n == 1:
            tables.store.write(f"leases/{1:012d}-{clock.now + 50:.3f}-dead", "")
    clock.now += 40
    assert tables.sweep(10) == []
    clock.now += 20
    assert len(tables.sweep(10)) == 1 and version.table("t").count() == 2


def test_one_of_several_reports_makes_the_new_version(spark, tmp_path):
    tables = Snapshots(spark, str(tmp_path / "t"), Clock())
    barrier, got = threading.Barrier(3), []

    def make(draft):
        barrier.wait()
        draft.write("t", spark.range(5))

    def report():
        got.append(tables.kept(600, make))

    threads = [threading.Thread(target=report) for _ in range(3)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert {v.number for v in got} == {1} and len({v.name for v in got}) == 1
    assert all(v.table("t").count() == 5 for v in got) and len(tables.store.names("versions")) == 1


def test_nothing_published(spark, tmp_path):
    tables = Snapshots(spark, str(tmp_path / "t"))
    assert tables.current() is None
    with pytest.raises(LookupError), tables.leased():
        pass


def test_a_name_is_taken_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.write("x/1", "é")
    with pytest.raises(Taken):
        store.write("x/1", "other")
    assert store.read("x/1") == "é" and store.names("x") == ["1"] and store.names("none") == []
    assert json.loads('"é"') == "é"
