import io
import tarfile

import numpy as np
import pytest

from prismlake.functions import raster
from prismlake.sources import images, urls


def test_catalogs():
    assert [len(urls.ARCHIVES[s]) for s in ("mvtec_ad", "mvtec_loco", "mvtec_ad2")] == [15, 5, 8]
    for source, found in urls.ARCHIVES.items():
        assert list(found) == images.SOURCES[source] and all(f"/{c}.tar" in u for c, u in found.items())
    with pytest.raises(ValueError, match="bottle, cable"):
        urls.archive_of("mvtec_ad", "nothing")


@pytest.mark.parametrize("kind", ["", "gz", "xz"])
def test_fetch_and_unpack(tmp_path, kind):
    archive = tmp_path / f"a.tar.{kind}"
    with tarfile.open(archive, f"w:{kind}") as t:
        info = tarfile.TarInfo("a/x.txt")
        info.size = 2
        t.addfile(info, io.BytesIO(b"hi"))
    got = images.fetch(archive.as_uri(), str(tmp_path / "copy.tar"))
    assert images.fetch("file:///nowhere", got) == got  # it is there already
    images.unpack(got, str(tmp_path / "out"))
    assert (tmp_path / "out" / "a" / "x.txt").read_text() == "hi"


def test_image_tree(spark, tmp_path):
    image = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    for name in ("train/good/1.png", "train/good/1.bmp", "test/bad/2.PNG", "other/x/3.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(raster.png(image) if name != "train/good/1.bmp" else b"no image")
    (tmp_path / "test/bad/notes.txt").write_text("x")
    rows = {(r["split"], r["label"], r["stem"]): r for r in images.image_tree(spark, str(tmp_path)).collect()}
    assert set(rows) == {("train", "good", "1"), ("test", "bad", "2")}
    r = rows["train", "good", "1"]
    assert np.array_equal(raster.from_spark(r["height"], r["width"], r["channels"], r["data"]), image)


def test_manifests(spark, tmp_path):
    (tmp_path / "m.csv").write_text("object,split,label,image,mask\na,train,normal,1.png,\na,test,anomaly,1.png,1m.png\nb,train,normal,2.png,\n")
    got = images.split_manifest(spark, str(tmp_path / "m.csv"), "a").collect()
    assert [(r["image"], r["split"], r["mask"]) for r in got] == [("1.png", "test", "1m.png")]
    assert images.annotation_manifest(spark, str(tmp_path / "none.csv")).count() == 0
    with pytest.raises(FileNotFoundError):
        images.categories(spark, str(tmp_path))
    (tmp_path / "split_csv").mkdir()
    (tmp_path / "m.csv").rename(tmp_path / "split_csv" / "1cls.csv")
    assert images.categories(spark, str(tmp_path)) == ["a", "b"]


def test_npy(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6, dtype=np.float16).reshape(2, 3))
    r = images.npy_files(spark, str(tmp_path)).first()
    assert r["shape"] == [2, 3] and r["data"] == [0, 1, 2, 3, 4, 5]


def test_exports(spark, tmp_path):
    from prismlake.sources import exports

    masks = spark.createDataFrame([("test", "good", "1_00", 2, 3, bytearray([0, 1, 0, 1, 1, 0]))], "split string, label string, instance_id string, h int, w int, mask binary")
    maps = spark.createDataFrame([("test", "good", "1", 1, 2, [0.5, 1.0])], "split string, label string, stem string, h int, w int, data array<float>")
    exports.write_files(exports.mask_files(masks), str(tmp_path))
    exports.write_files(exports.heatmap_files(maps), str(tmp_path))
    read = spark.read.format("image").load(str(tmp_path / "masks/test/good/1_00.png")).select("image.data").first()[0]
    assert list(read) == [0, 255, 0, 255, 255, 0]
    assert np.load(tmp_path / "heatmaps/refined/test/good/1.npy").tolist() == [[0.5, 1.0]]
    exports.write_csv(spark.createDataFrame([("a", None, [1, 2])], "id string, s string, size array<int>"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()[:] == ("a", None, "[1,2]")
    bank = spark.createDataFrame([(2, "b"), (1, "c"), (2, "b")], "rank int, instance_id string")
    assert [r[0] for r in exports.bank_list(bank).collect()] == ["c", "b"]
