"""From PNG files to metrics, and stages that aren't run twice."""

import numpy as np
import pytest

from prismlake import config as cfg
from prismlake.catalog import Catalog
from prismlake.functions import raster
from prismlake.plans import project as projects
from prismlake.plans import stages

CONFIG = cfg.merged(cfg.DEFAULTS, {"transformer": {"patch_size": 4, "map_resolution": [8, 8]}, "refine": {"gaussian_sigma": 1}, "segmentation": {"enabled": False}})


def write(root, split, label, stem, image):
    folder = root / split / label
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{stem}.png").write_bytes(raster.png(image))


@pytest.fixture(scope="module")
def dataset(tmp_path_factory):
    root, rng = tmp_path_factory.mktemp("data"), np.random.default_rng(0)
    for i in range(5):
        write(root, "train", "good", f"{i:03d}", rng.integers(95, 105, (32, 32)).astype(np.uint8))
        write(root, "test", "good", f"{i:03d}", rng.integers(95, 105, (32, 32)).astype(np.uint8))
        bad = rng.integers(95, 105, (32, 32)).astype(np.uint8)
        truth = np.zeros((32, 32), np.uint8)
        bad[8:16, 12:20] = rng.integers(0, 255, (8, 8))
        truth[8:16, 12:20] = 255
        write(root, "test", "scratch", f"{i:03d}", bad)
        write(root, "ground_truth", "scratch", f"{i:03d}_mask", truth)
    return root


def test_end_to_end(spark, dataset, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/tables")
    projects.prepare_project(catalog, "local", "demo", str(dataset), name="demo")
    counts = projects.ingest_counts(catalog, "demo").first()
    assert (counts["train"], counts["test_normal"], counts["test_anomaly"], counts["defects"]) == (5, 5, 5, "scratch")
    done = projects.process_project(catalog, "demo", CONFIG)
    assert done["stages_run"] == cfg.STAGES and done["instances"] == 15
    assert projects.process_project(catalog, "demo", CONFIG)["stages_run"] == []
    found = projects.score_project(catalog, "demo", CONFIG, min_pct=90, max_pct=99, pixel_sample=None)
    assert found["auroc_image"] == 1.0 and found["auroc_pixel"] > 0.9 and found["per_defect"] == {"scratch": 1.0}
    assert catalog.runs("demo").count() == 1 and "auroc_scratch" in catalog.runs("demo").columns
    registry = projects.registry(catalog, "demo")
    assert registry.count() == 15 and registry.where("in_bank").count() == 5
    assert projects.registry(catalog, "demo", compat=True).where("in_bank").count() == 15  # by id alone, all labels
    softer = cfg.merged(CONFIG, {"refine": {"gaussian_sigma": 2}})
    assert catalog.invalid_stages("demo", softer) == ["refine"]
    assert catalog.invalid_stages("demo", cfg.merged(CONFIG, {"crop": {"scale": 0.5}})) == cfg.STAGES[1:]
    assert projects.process_project(catalog, "demo", softer)["stages_run"] == ["refine"]
    with pytest.raises(ValueError):
        projects.process_project(catalog, "demo", CONFIG, force_from="nothing")
    with pytest.raises(FileNotFoundError):
        projects.process_project(catalog, "other", CONFIG)
    assert projects.score_project(catalog, "other", CONFIG) is None


def test_segmentation(spark, dataset, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/tables")
    projects.prepare_project(catalog, "local", "demo", str(dataset), name="demo")
    images = catalog.read("images", "demo").drop("project").where("split = 'test' AND label = 'scratch'")
    two = stages.Context(cfg.merged(CONFIG, {"segmentation": {"enabled": True, "prompts": ["a", "b"], "multi_instance": False}}), segmenter=lambda image, prompt: [image > 200, image < 50])
    masks = stages.segment(two, images)
    assert masks.count() == 10 and {r["instance_id"][-3:] for r in masks.collect()} == {"_00", "_01"}
    assert all(r["mask_area_px"] == sum(r["mask"]) for r in masks.collect())
    none = stages.Context(two.config, segmenter=lambda image, prompt: None)
    with pytest.raises(stages.SegmentationError, match="no mask for: test/scratch/000"):
        stages.require_masks(images, stages.segment(none, images))


def test_models_take_batches(spark, dataset, tmp_path):
    """A model with `many` is called with several images at once and gives the same rows."""
    catalog = Catalog(spark, f"file://{tmp_path}/tables")
    projects.prepare_project(catalog, "local", "demo", str(dataset), name="demo")
    images = catalog.read("images", "demo").drop("project")

    class Segmenter:
        def __call__(self, image, prompt):
            return [image > 100]

        def many(self, pictures, prompt):
            assert 0 < len(pictures) <= 3
            return [[image > 100] for image in pictures]

    class Embedder:
        def __call__(self, image, grid):
            return stages.patch_statistics(image, grid)

        def many(self, pictures, grid):
            assert 0 < len(pictures) <= 2
            return np.stack([stages.patch_statistics(image, grid) for image in pictures])

    on = cfg.merged(CONFIG, {"segmentation": {"enabled": True}})
    several = stages.Context(on, Segmenter(), Embedder(), segment_batch=3, embed_batch=2)
    single = stages.Context(on, lambda image, prompt: [image > 100], stages.patch_statistics)
    rows = []
    for ctx in (several, single):
        masks = stages.segment(ctx, images)
        patches = stages.embed(ctx, stages.crop(ctx, images, masks))
        rows.append((sorted(map(str, masks.collect())), sorted(map(str, patches.collect()))))
    assert rows[0] == rows[1] and len(rows[0][1]) == 15 * 64


def test_runs_keep_instances_and_configuration(spark, dataset, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/tables")
    projects.prepare_project(catalog, "local", "demo", str(dataset), name="demo")
    assert catalog.project_config("demo") == cfg.DEFAULTS
    catalog.save_project_config("demo", CONFIG)
    projects.prepare_project(catalog, "local", "demo", str(dataset), name="demo")
    assert catalog.project_config("demo") == CONFIG  # not overwritten
    projects.process_project(catalog, "demo", CONFIG)
    run = projects.score_project(catalog, "demo", CONFIG, pixel_sample=100)["run_id"]
    assert catalog.registry("demo").count() == catalog.run_instances(run).count() == 15
    assert catalog.run_config(run) == CONFIG and catalog.run_config("none") is None
    with pytest.raises(FileNotFoundError):
        catalog.run_instances("none")
    quiet = projects.process_project(catalog, "empty", CONFIG, compat=True)
    assert quiet["stages_run"] == [] and quiet["stages_skipped"] == cfg.STAGES and quiet["instances"] == 0


def test_prepare_downloads(spark, dataset, tmp_path, monkeypatch):
    import tarfile

    from prismlake.sources import urls

    with tarfile.open(tmp_path / "bottle.tar.xz", "w:xz") as t:
        t.add(dataset, "bottle")
    monkeypatch.setattr(urls, "archive_of", lambda source, category: (tmp_path / "bottle.tar.xz").as_uri())
    catalog = Catalog(spark, f"file://{tmp_path}/tables")
    for _ in range(2):  # the second time it is there
        projects.prepare_project(catalog, "mvtec_ad", "bottle", str(tmp_path / "datasets"), download=True)
    assert catalog.read("images", "bottle").count() == 15 and catalog.read("ground_truth", "bottle").count() == 5


def test_prepare_rejects(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/tables")
    with pytest.raises(ValueError):
        projects.prepare_project(catalog, "mvtec_ad", "nothing", str(tmp_path))
    with pytest.raises(ValueError):
        projects.prepare_project(catalog, "nowhere", "bottle", str(tmp_path))


def test_visa_manifest(spark, tmp_path):
    rng = np.random.default_rng(0)
    data = tmp_path / "candle" / "Data" / "Images"
    for name in ("Normal/1", "Normal/2", "Anomaly/1"):
        (data / name).parent.mkdir(parents=True, exist_ok=True)
        (data / f"{name}.png").write_bytes(raster.png(rng.integers(0, 255, (8, 8)).astype(np.uint8)))
    (tmp_path / "split_csv").mkdir()
    rows = ["object,split,label,image,mask", "candle,train,normal,candle/Data/Images/Normal/1.png,", "candle,test,normal,candle/Data/Images/Normal/2.png,",
            "candle,train,anomaly,candle/Data/Images/Anomaly/1.png,", "pcb1,train,normal,x.png,"]
    (tmp_path / "split_csv" / "1cls.csv").write_text("\n".join(rows))
    catalog = Catalog(spark, f"file://{tmp_path}/tables")
    projects.prepare_project(catalog, "visa", "candle", str(tmp_path))
    got = {(r["split"], r["label"], r["stem"]) for r in catalog.read("images", "candle").collect()}
    assert got == {("train", "good", "1"), ("test", "good", "2"), ("test", "anomaly", "1")}
