from kinweave.storage import Scratch, shared_folder


def test_scratch(spark, made):
    scratch = Scratch(spark, "t")
    kept = scratch.save(made([(1, None), (2, "x")], "a int, b string"), "one")
    assert kept.count() == 2 and scratch.root.startswith(shared_folder(spark))
    scratch.save(kept, "two")
    scratch.drop("one")
    assert scratch.load("two").count() == 2
    scratch.clear()
    fresh = Scratch(spark, "t")
    assert fresh.root != scratch.root and fresh.save(made([], "a int"), "none").count() == 0


def test_a_cluster_has_to_name_its_folder():
    from types import SimpleNamespace

    import pytest

    from kinweave.storage import shared_folder

    unset = SimpleNamespace(get=lambda *a: None)
    session = lambda master: SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master=master, getConf=lambda: unset))
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,512]"):
        with pytest.raises(RuntimeError):
            shared_folder(session(master))
