"""A small map through the commands: cells, tiles, an update, an extract."""

import json

from geostrata import cli
from geostrata.sources import pbf

OSC = '<osmChange version="0.6"><modify><node id="1" version="2" lon="10" lat="10"/></modify><create><node id="7" version="1" lon="-20" lat="5"/></create><delete><node id="3" version="2" lon="0" lat="0"/></delete></osmChange>'


def test_build_update_extract(spark, tmp_path, capfd):
    t = str(tmp_path)
    rows = [(0, k, 0, 1, 1, 1000 + k, 1, "u", [], k * 1000000, k * 1000000, None, None, None, None) for k in range(1, 6)]
    rows += [(1, 1, 0, 1, 1, 2000, 1, "u", [("b", "1"), ("a", "2")], None, None, [1, 2], None, None, None), (2, 1, 0, 1, 1, 3000, 1, "u", [], None, None, None, [("r", 1, 1)], None, None)]
    spark.createDataFrame(rows, pbf.SCHEMA).write.parquet(f"{t}/map")
    cli.main(["count", f"{t}/map"])
    told = capfd.readouterr().out
    assert "|5    |1     |5     |1001  |1005  |1000000|5000000|1000000|5000000|" in told
    cli.main(["calcqts", f"{t}/map", "--out", f"{t}/qts", "--prelim", f"{t}/ways"])
    cli.main(["calcqts", f"{t}/map", "--out", f"{t}/qts.pbf", "--existing", f"{t}/ways"])
    assert sorted(map(tuple, cli.load_cells(spark, f"{t}/qts.pbf").collect())) == sorted(map(tuple, spark.read.parquet(f"{t}/qts").collect()))
    cli.main(["sortblocks", f"{t}/map", "--qts", f"{t}/qts.pbf", "--out", f"{t}/db", "--target", "60", "--least", "2", "--end-date", "2024-01-01T00:00:00"])
    (tmp_path / "diffs").mkdir()
    (tmp_path / "diffs/1.osc").write_text(OSC)
    cli.main(["update-initial", f"{t}/db", "--diffs", f"{t}/diffs"])
    cli.main(["update", f"{t}/db", "--demo"])
    assert len(json.loads((tmp_path / "db/filelist.json").read_text())) == 1 and (tmp_path / "db/1-demo").is_dir()
    cli.main(["update", f"{t}/db"])
    assert json.loads((tmp_path / "db/filelist.json").read_text())[-1]["State"] == 1
    cli.main(["mergechanges", f"{t}/db", "--out", f"{t}/now", "--sort"])
    now = {(r["elem_type"], r["id"]): r for r in spark.read.parquet(f"{t}/now").collect()}
    assert set(now) == {(0, 1), (0, 2), (0, 4), (0, 5), (0, 7), (1, 1), (2, 1)} and now[0, 1]["lon"] == 100000000
    cli.main(["mergechanges", f"{t}/db", "--out", f"{t}/then", "--timestamp", "2024-01-01T00:00:00", "--filter", "0,0,1500000,1500000", "--objects"])
    assert {(r["elem_type"], r["id"]) for r in spark.read.parquet(f"{t}/then").collect()} == {(0, 1), (0, 2), (1, 1), (2, 1)}
    assert spark.read.parquet(f"{t}/then").where("elem_type = 2").first()["members"][0]["mem_ref"] == 1
    assert {p.name for p in (tmp_path / "db").iterdir()} >= {"base-index", "1.parquet-index", "groups"}
    lines = [x for p in (tmp_path / "db/groups").glob("part-*") for x in p.read_text().split()]
    assert lines and all(len(x.split(";")) == 3 for x in lines)
    cli.main(["diff", f"{t}/then", "--right", f"{t}/now", "--out", f"{t}/diff"])
    found = [json.loads(x) for p in (tmp_path / "diff").glob("part-*") for x in p.read_text().splitlines()]
    assert {next(iter(x)) for x in found} == {"DifferentInfo", "OnlyRight"} and len(found) == 4
    cli.main(["setup", f"{t}/new", "--source", "https://x.example/", "--state", "5"])
    assert json.loads((tmp_path / "new/settings.json").read_text())["InitialState"] == 5 and (tmp_path / "new/diffs").is_dir()
    cli.main(["update-drop-last", f"{t}/db"])
    cli.main(["mergechanges", f"{t}/db", "--out", f"{t}/out.pbf", "--sort"])
    assert len(json.loads((tmp_path / "db/filelist.json").read_text())) == 1
