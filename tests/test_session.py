"""Session helpers."""

from __future__ import annotations

from ledgerline.session import SKEW_CONF, apply_skew_conf, ensure_checkpoint_dir


def test_checkpoint_dir_comes_from_the_session(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    got = ensure_checkpoint_dir(spark)
    assert got
    if configured:                      # the session's own setting wins
        assert configured.rstrip("/").split("/")[-1] in got


def test_skew_settings_are_applied(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    try:
        for k in SKEW_CONF:
            spark.conf.set(k, "false")
        apply_skew_conf(spark)
        assert all(spark.conf.get(k) == v for k, v in SKEW_CONF.items())
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
