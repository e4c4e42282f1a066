"""The join keys of near-duplicates stay an expression that Spark compiles."""

from pyspark.sql import functions as F

from meshledger.llm import simhash


def test_distances_and_join_keys_compile(spark):
    settings = {"spark.sql.codegen.fallback": "false", "spark.sql.codegen.factoryMode": "CODEGEN_ONLY"}
    # of each three, the second tells from the first in a bit of the first group, the third in one of the last
    fps = spark.range(300).select(F.xxhash64(F.floor(F.col("id") / 3)).bitwiseXOR(
        F.when(F.col("id") % 3 == 1, 1).when(F.col("id") % 3 == 2, 1 << 62).otherwise(0)).alias("fp"))
    refs = simhash.references(fps)
    assert len(refs) == simhash.REFERENCES
    table = simhash.distance_table(fps, refs)
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        rows = table.select("fp", "d", F.explode(simhash._codes(refs, simhash.GROUPS, simhash.MAX_BITS)).alias("k")).collect()
    finally:
        for key in settings:
            spark.conf.unset(key)
    want, keys = {}, {}
    mask = (1 << 64) - 1
    for r in rows:
        pivots = [(p ^ m) & mask for p in refs for m in [0, *simhash.masks()]]
        assert list(r.d) == [bin((r.fp & mask) ^ p).count("1") for p in pivots]
        chosen = list(simhash.combinations(range(simhash.GROUPS), simhash.GROUPS - simhash.MAX_BITS))[r.k.choice]
        inside = tuple(bin((r.fp ^ p) & simhash.masks()[g]).count("1") for p in refs for g in chosen)
        want.setdefault((r.k.choice, inside), set()).add(r.fp)
        keys.setdefault((r.k.choice, r.k.code), set()).add(r.fp)
    # the keys part the fingerprints as the distances inside the chosen groups do
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, keys.values()))
    assert len(rows) == 300 * 10
    assert len(keys) < 300 * 10
