"""The simulated camera against the counts that the reference's metadata gives for its own random stream."""

from pyspark.sql import functions as F

from clearfield.operators import voxels
from clearfield.plans import registry
from clearfield.sources import shapes


def test_views_noise_and_reservoir(spark):
    clean = shapes.depth_camera(spark, noise=0.0, dropout=0.0, grazing=0.0, quantum=1e-9)
    assert clean.count() == 9092  # surface hits of 69,120 rays, which no random number touches
    low, high = clean.agg(F.min("z"), F.max("z")).first()
    assert low < 0.5102 and high > 0.9898  # the poles, at 0.51 and 0.99, are seen
    seen = shapes.depth_camera(spark).cache()
    assert abs(seen.count() - 7858) < 150
    both = clean.join(seen.withColumn("kept", F.lit(1)).select("frame_id", "point_id", "kept"), ["frame_id", "point_id"], "left")
    # Grazing pixels drop out more often.
    d = shapes.depth_camera(spark, noise=0.0, dropout=0.0, quantum=1e-9)
    assert 0.05 < 1 - d.count() / 9092 < 0.1 and both.where("kept is null").count() == 9092 - seen.count()
    moved = clean.select("frame_id", "point_id", *[F.col(c).alias(f"b{c}") for c in "xyz"]).join(seen, ["frame_id", "point_id"])
    rms = moved.agg(F.sqrt(F.avg(sum(((F.col(c) - F.col(f"b{c}")) ** 2 for c in "yz"), (F.col("x") - F.col("bx")) ** 2)))).first()[0]
    assert abs(rms - 0.00197) < 0.0003
    cloud = shapes.camera_cloud(seen).cache()
    n = cloud.count()
    assert n == voxels.voxelize(seen.withColumn("frame_id", F.lit(0).cast("long")), 0.018).count() and abs(n - 1655) < 60
    assert abs(voxels.voxelize(cloud, 0.04).count() - 341) < 15
    got = {r.frame_id: r for r in registry.depth_camera(spark, "").collect()}
    assert set(got) == set(range(11)) and (got[10].min_iz, got[10].max_iz) in ((12, 24), (12, 25), (13, 24))
    print(seen.count(), rms, n, voxels.voxelize(cloud, 0.04).count(), got[10])
