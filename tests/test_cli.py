import json

import numpy as np

from lumenstack.plans import cli
from lumenstack.sources import tiff


def test_convert_then_register(spark, tmp_path):
    images = [np.zeros((8, 9), np.uint8) for _ in range(5)]
    for k, image in enumerate(images):
        image[3:5, 3 + (k == 2) : 6 + (k == 2)] = 9
    tiff.write_pages(str(tmp_path / "a.tif"), images)
    (tmp_path / "c.json").write_text(json.dumps({"axis": 0, "channel": 0, "__comment__": "pages are time"}))
    (tmp_path / "r.json").write_text(json.dumps({"max_iters": 5, "include_shift": True}))
    assert cli.main("convert", str(tmp_path / "c.json"), str(tmp_path / "frames"), str(tmp_path / "a.tif")) == 0
    assert cli.main("register", str(tmp_path / "r.json"), str(tmp_path / "fixed"), str(tmp_path / "frames")) == 0
    fixed = {r.t: r for r in spark.read.parquet(str(tmp_path / "fixed")).collect()}
    assert {tuple(r.shape) for r in fixed.values()} == {(8, 8)} and len({tuple(r.data) for r in fixed.values()}) == 1
    assert {r.t: r.dx for r in spark.read.parquet(str(tmp_path / "fixed_shift")).collect()} == {0: 0, 1: 0, 2: -1, 3: 0, 4: 0}
