import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"

#: Nulls, empty and blank texts, ties, repeated rows, and a long text.
TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "Two words",
    "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 8,
    "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 8,
    "Alpha beta gamma delta epsilon zeta eta theta iota kappa " * 8 + "end",
    " ".join(f"w{i * 7 % 3001}" for i in range(30_000)),
    "mail a.b@example.com or call +1 (555) 010-9999, card 4111 1111 1111 1111 ip 10.0.0.255\nlicensed under the GNU General Public License version 3",
    "token = \"0123456789abcdef0123456789abcdef01234567\" été 漢字 \U0001f600 x@y.z",
    "hello <|endoftext|> world<|startoftext|>",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Edge cases, with a repeated row, and extra columns whose names clash with results."""
    data = [(i, t, None if i % 3 else "en", "s" if i % 2 else None, len(t or ""), 7, "x", True, True, 1.0, "y", "z", 3, 0) for i, t in enumerate(TEXTS)]
    data.append(data[5])
    clashing = "N_HIT int, spans string, kept boolean, _kept boolean, _distance double, _q string, _pii string, key int, `_m0_key` int"
    return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {clashing}").repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where(F.lit(False))


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
