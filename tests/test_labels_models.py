import numpy as np
from pyspark.sql import functions as F

from cellweft.functions import labels
from cellweft.operators import latent
from cellweft.sinks import models


def test_labels_and_colours(spark):
    rows = [
        ("expr__CSF1R_log1p", None, None, None),
        ("chr5:100-300__H3K27ac", "fire_core; other_one", 5.0, True),
        ("chr5:1000000-3000000__H3K9me3", "", None, False),
        ("chr5:100-300__H3K99", None, -1250.0, None),
        ("my_region__H3K4me1", None, 3.0, None),
        ("plain", None, None, None),
    ]
    df = spark.createDataFrame(rows, "node string, curated string, distance double, over boolean")
    n = F.col("node")
    got = df.select(labels.node_label(n), labels.local_label(n, F.col("curated"), F.col("distance")), labels.node_color(n), labels.outline_color(n, F.col("over"))).collect()
    assert [tuple(r) for r in got] == [
        ("expr\nCSF1R_log1p", "CSF1R_log1p", "#f4a261", "#9c4221"),
        ("chr5:100-300\nH3K27ac", "H3K27ac\nFIRE core", "#e76f51", "#d7263d"),
        ("chr5:1000000-3000000\nH3K9me3", "H3K9me3\n2.000 Mb", "#8d99ae", "#264653"),
        ("chr5:100-300\nH3K99", "H3K99\n-1.2 kb", "#8ecae6", "#264653"),
        ("my region\nH3K4me1", "my_region\nH3K4me1", "#d3d3d3", "#264653"),
        ("plain", "plain", "#d3d3d3", "#264653"),
    ]
    assert spark.range(0).select(labels.node_label(F.lit(None).cast("string"))).collect() == []


def test_model_round_trip(tmp_path):
    model = latent.fit_arrays(np.eye(4), np.array([0, 1, 0, 1]), np.ones((4, 4)), latent=2, hidden=4, epochs=2)
    models.write_model(model, ["rna", "chrom_A"], tmp_path / "m.npz")
    back, kinds = models.read_model(tmp_path / "m.npz")
    assert kinds == ["rna", "chrom_A"] and np.array_equal(back.encode(np.eye(4)), model.encode(np.eye(4)))
