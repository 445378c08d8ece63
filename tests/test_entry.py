"""The driver contract: what registers with and without the subpackage of training-text operators."""

import builtins
import sys

import __spark_entry__


def test_a_library_missing_in_the_subpackage_leaves_the_rest(monkeypatch):
    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name == "factgate.llm" or name.startswith("factgate.llm."):
            raise ImportError(name)
        return real(name, *args, **kwargs)

    def load(name, package=None):
        if name.startswith("factgate.llm"):
            raise ImportError(name)
        return sys.modules.get(name) or real(name, fromlist=["x"])

    whole = set(__spark_entry__.queries())
    monkeypatch.setattr(__spark_entry__.importlib, "import_module", load)
    rest = set(__spark_entry__.queries())
    assert "p1_found" in rest and rest <= whole and not any(k.startswith(("p2_", "p3_", "p4_", "p7_", "p8_", "p9_", "p10_")) for k in rest)


def test_every_oracle_belongs_to_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_a_cluster_without_a_shared_folder_is_refused():
    import pytest

    from factgate.session import ensure_checkpoint_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())
