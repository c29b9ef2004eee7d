"""Tree files, burn-in, names, tables written, the command line, and the stream."""

import gzip

import pytest

from cladeflow import api
from cladeflow.__main__ import main
from cladeflow.sources import format_number, read_beast_trees, read_tree_files, write_matrix_tsv
from cladeflow.sources.nexus import file_lines, translate_table, tree_lines
from cladeflow.streaming import stream_splits

A, B = "((1:1,2:1):1,(3:1,4:1):1);", "((1:1,3:1):1,(2:1,4:1):1);"


def nexus(trees, translate="\t1 'a',\n\t2 b,\n\t3 c c2,\n\t4 d\n\t;\n", end="End;\n"):
    head = f"#NEXUS\nBegin trees;\n\tTranslate\n{translate}" if translate is not None else "#NEXUS\nBegin trees;\n"
    return head + "".join(f"tree STATE_{s} = [&R] {t}\n" for s, t in trees) + end


@pytest.fixture
def run(tmp_path):
    p = tmp_path / "run.trees"
    p.write_text(nexus([(10 * i, A if i % 2 else B) for i in range(10)]))
    return str(p)


def test_scan(spark, run):
    lines = file_lines(spark, [run])
    assert [(r.id, r.label) for r in translate_table(lines).orderBy("id").collect()] == [("1", "a"), ("2", "b"), ("3", "c"), ("4", "d")]
    rows = tree_lines(lines).orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(10)) and rows[3].header == "tree STATE_30" and rows[3].body == f"[&R] {A}"


@pytest.mark.parametrize(("trees", "states", "want"), [(0, 0, list(range(10))), (5, 0, [5, 6, 7, 8, 9]), (0, 30, [4, 5, 6, 7, 8, 9]), (5, 20, [3, 4, 5, 6, 7, 8, 9])])
def test_burn_in(spark, run, trees, states, want):
    rows = read_tree_files(spark, [run], trees, states).orderBy("tree_id").collect()
    assert [r.idx for r in rows] == want and [r.tree_id for r in rows] == list(range(len(want)))
    assert rows[0]["name"] == f"file0_run_STATE_{10 * want[0]}"


def test_odd_files(spark, tmp_path):
    def rows(text):
        p = tmp_path / "x.trees.trees"
        p.write_bytes(text.encode())
        return [(r["name"], int(r.state), r.newick) for r in read_beast_trees(spark, str(p), use_real_taxa=False)[1].orderBy("tree_id").collect()]

    assert rows("\ttree STATE_0 = (a,b);\n") == []
    assert rows("tree foo = (a,b);\r\nno tree\r\nx y = (a,c);\r\n  end;\r\ntree STATE_5 = (a,d);\r\n") == [("x_", 0, "(a,b);"), ("x_", 0, "(a,c);")]
    assert rows("TREE state_7 = (a,b);\ntree STATE_8 = (a,b\ntree q_STATE_99999999999999999999999 = (a,c);") == [("x_state_7", 7, "(a,b);"), ("x_", 0, "(a,c);")]
    empty, none = read_beast_trees(spark, str(tmp_path / "missing.trees"))
    assert empty.count() == none.count() == 0


def test_missing_labels_are_null(spark, tmp_path):
    p = tmp_path / "y.trees"
    p.write_text(nexus([(1, A)], translate=None))
    from cladeflow.operators import parse

    trees = read_tree_files(spark, [str(p)])
    assert {r["name"] for r in parse(trees, use_map=True)[0].collect()} == {None}


def test_api_on_files(spark, run, tmp_path):
    second = tmp_path / "b.trees"
    second.write_text(nexus([(5, A), (6, B)]))
    names, m = api.pairwise_rf([run], burnin_states=70)
    assert names == ["file0_run_STATE_80", "file0_run_STATE_90"]
    names, m = api.pairwise_rf([run, str(second)])
    assert len(names) == 12 and names[-1] == "file1_b_STATE_6"
    assert m[0][1] == 2 and m[0][2] == 0 and m[1][10] == 0 and all(m[i][i] == 0 for i in range(12))
    assert api.pairwise_rf([run], rooted=True)[1][0][1] == 4
    assert api.pairwise_weighted_rf([run])[1][0][1] == 4.0
    assert api.pairwise_kf([run])[1][0][1] == pytest.approx(8**0.5)
    for call, message in (
        (lambda: api.pairwise_rf([]), "No trees found in any of the provided files"),
        (lambda: api.pairwise_rf([run], burnin_trees=99), "No trees found in file"),
        (lambda: api.pairwise_rf([str(tmp_path / "none.trees")]), "No trees found in file"),
    ):
        with pytest.raises(ValueError, match=message):
            call()
    with pytest.raises(OverflowError):
        api.pairwise_rf([run], burnin_trees=-1)


def test_tables(tmp_path, capsys):
    assert [format_number(x) for x in (164.0, 0, 1e-7, 2.5, 1e21, 0.1 + 0.2)] == ["164", "0", "0.0000001", "2.5", "1000000000000000000000", "0.30000000000000004"]
    want = "\ta\tb\na\t0\t1.5\nb\t1.5\t0\n"
    m = [[0, 1.5], [1.5, 0]]
    write_matrix_tsv(str(tmp_path / "m.tsv"), ["a", "b"], m)
    write_matrix_tsv(str(tmp_path / "m.tsv.gz"), ["a", "b"], m)
    write_matrix_tsv("-", ["a", "b"], m)
    assert (tmp_path / "m.tsv").read_text() == gzip.open(tmp_path / "m.tsv.gz", "rt").read() == capsys.readouterr().out == want


def test_command_line(spark, run, tmp_path):
    out = tmp_path / "d.tsv"
    assert main(["-i", run, "-o", str(out), "-t", "8", "--metric", "weighted", "--use-real-taxa", "-q"]) == 0
    assert out.read_text() == "\trun_STATE_80\trun_STATE_90\nrun_STATE_80\t0\t4\nrun_STATE_90\t4\t0\n"
    assert main(["-i", run, "-o", str(out), "-t", "9", "-q"]) == 0
    assert out.read_text() == "\trun_STATE_90\nrun_STATE_90\t0\n"
    assert main(["-i", run, "-o", str(out), "-t", "99", "-q"]) == 2
    assert main(["-i", run, "-o", str(tmp_path / "no/such/d.tsv"), "-q"]) == 4


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i, t in enumerate(("(a,(b,(c,d)));", "((a,c)[&x],b,d);")):
        (src / f"{i}.tsv").write_text(f"t{i}\t{t}\n")
        stream_splits(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("name").collect()
    assert [(r["name"], list(r.split)) for r in rows] == [("t0", [2, 3]), ("t1", [1, 3])]
