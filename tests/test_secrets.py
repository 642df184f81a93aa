"""Patterns of secrets: what has a format is found, what only looks like it isn't."""

import pytest
from pyspark.sql import functions as F

from cadenza.plans.record_queries import secrets_in

R = "aB3" * 40
FOUND = [
    (f"Bearer eyJ{R[:17]}.eyJ{R[:10]}.{R[:43]}", ["jwt"]), (f"ghp_{R[:36]}", ["github"]), (f"github_pat_{R[:22]}_{R[:59]}", ["github"]), ("ASIA" + "ABCD2345" * 2, ["aws"]), (f"sk-{R[:20]}T3BlbkFJ{R[:20]}", ["openai"]),
    ("-----BEGIN RSA PRIVATE KEY-----", ["private_key"]), ("-----BEGIN PRIVATE KEY-----", ["private_key"]), (f"AccountKey={R[:86]}==;", ["storage_key"]), (f"https://x/y?a=1&sig={R[:42]}%2B", ["signed_link"]), ("Password: hunter2hunter2", ["assigned"]), ("me@example.org", ["email"]),
]
NONE = [f"eyJ{R[:10]}.eyJ{R[:10]}.{R[:43]}", f"eyJ{R[:17]}.eyJ{R[:10]}.", f"ghp_{R[:35]}", f"github_pat_{R[:22]}_{R[:50]}", "AKIA" + "ABCD1890" * 2, f"sk-{R[:50]}", "-----BEGIN PUBLIC KEY-----", f"AccountKey={R[:80]}==", "?sig=short", "password: x", "at@home", "", None]


@pytest.mark.parametrize("cases", [FOUND, [(t, []) for t in NONE]])
def test_secrets(spark, cases):
    x = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = dict(x.select("i", secrets_in(F.col("t"))).collect())
    assert got == {i: k for i, (_, k) in enumerate(cases)}
