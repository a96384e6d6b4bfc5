"""What tasks hold of texts does not depend on how long the texts are."""

from wharfline.llm import common


def test_batches_of_long_texts_are_small(spark):
    """pipeline: 10,000 rows of whole texts were one batch, held several times over beside what earlier stages left in the workers."""
    common.ship(spark)
    texts = spark.range(0, 4000, 1, 1).selectExpr("id", "repeat('0123456789', 1000) as text")

    def sizes(frames):
        for f in frames:
            yield f.assign(size=f["text"].str.len().sum())[["id", "size"]].head(1)

    got = [r["size"] for r in texts.mapInPandas(sizes, "id long, size long").collect()]
    assert sum(got) == 40_000_000 and max(got) < 8_000_000


def test_a_session_s_own_batches_stay(spark):
    name = common.BATCH[0]
    before = spark.conf.get(name, None)
    try:
        spark.conf.set(name, "1m")
        common.ship(spark)
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
