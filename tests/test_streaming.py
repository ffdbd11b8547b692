from stratalog.operators import ttl
from stratalog.streaming.feed import fold_stream, read_log, run_batches

from .test_log import OPS


def test_stateful_fold_equals_the_batch_fold(spark, tmp_path):
    import random

    rng = random.Random(3)
    ops = [(i, i * 10, 0, rng.choice(["put", "put_ttl", "delete", "expire", "persist"]), f"k{rng.randrange(9)}", f"v{i}", rng.randrange(120)) for i in range(240)]
    folder = str(tmp_path / "ops")
    for k in range(3):
        spark.createDataFrame(ops[80 * k : 80 * k + 80], OPS).coalesce(1).write.mode("append").parquet(folder)
    state = {}
    stream = fold_stream(read_log(spark, folder, OPS, files_per_batch=1))
    q = run_batches(stream, str(tmp_path / "cp"), lambda df, _: state.update({r.key: r for r in df.collect()}))
    q.awaitTermination()
    live = {k: (r.value, r.expire_ns) for k, r in state.items() if r.alive and not 0 < r.expire_ns <= 2400}
    batch = ttl.state_as_of(spark.createDataFrame(ops, OPS), 2400).collect()
    assert live == {r.key: (r.value, r.expire_ns) for r in batch}
