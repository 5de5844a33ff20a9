import os
import sys
import tempfile

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tessera.session import get_session

    s = get_session(master="local[4]", app="tessera-tests", shuffle_partitions=4)
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-test-ckpt-"))
    yield s


def mat_from_dense(spark, a, sparse=True):
    from tessera.sources.entries import from_entries

    a = np.asarray(a, dtype=float)
    rows = [(int(i), int(j), float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1]) if a[i, j] != 0 or not sparse]
    df = spark.createDataFrame(rows, "i BIGINT, j BIGINT, v DOUBLE")
    return from_entries(df, a.shape[0], a.shape[1])


def vec_from_dense(spark, x):
    from tessera.sources.entries import vector_from_entries

    x = np.asarray(x, dtype=float)
    rows = [(int(i), float(x[i])) for i in range(len(x)) if x[i] != 0]
    df = spark.createDataFrame(rows, "i BIGINT, v DOUBLE")
    return vector_from_entries(df, len(x))


def dense(m):
    from tessera.operators.sinks import to_local

    return to_local(m)


def dense_vec(x):
    from tessera.operators.sinks import to_local_vec

    return to_local_vec(x)
