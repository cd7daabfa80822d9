import plain_structure as structure

from lodestar.operators import report
from lodestar.sources import files
from lodestar.streaming import progress

HTML = "<html><body><nav>menu</nav><main><h1>Title</h1><p>First words of a body.</p><h2>Part</h2><ul><li>One item that is long enough</li></ul><h3>Deep</h3><p>More text in here now.</p></main><footer>f</footer></body></html>"


def test_html_sections():
    got = structure.html_sections(HTML)
    assert [(s.level, s.title) for s in got] == [(1, "Title"), (2, "Part"), (3, "Deep")] and got[1].body == "One item that is long enough"
    assert [p.path for p in structure.with_paths("doc", got)] == [("doc", "Title"), ("doc", "Title", "Part"), ("doc", "Title", "Part", "Deep")]


def test_markdown_sections():
    got = structure.markdown_sections("Top\n===\nbody\n\n## Two\n```\n# no heading\n---\n```\n#### four ##\nx\n---\n|---|\n")
    assert [(s.level, s.title) for s in got] == [(1, "Top"), (2, "Two"), (2, "x")] and "# no heading\n---" in got[1].body
    assert got[1].body.endswith("```\nfour") and got[2].body == "|---|"


def test_html_cells_boilerplate_and_main_part():
    page = "<body><p>outside of the main part</p><main><h1>T</h1><table><tr><th>one of the heads</th><th>two of the heads</th></tr></table><p>* author of the widget</p><p>Please clear form and log out now</p><p>Menu</p></main></body>"
    (only,) = structure.html_sections(page)
    assert (only.title, only.body) == ("T", "one of the heads\ntwo of the heads")


def test_split_keeps_the_ceiling_and_overlaps():
    words = lambda s: len(s.split())
    parts = structure.split("\n\n".join(" ".join(f"p{i}w{j}" for j in range(n)) for i, n in enumerate((40, 30, 45, 10, 300))), words, 100)
    assert all(words(p) <= 100 for p in parts)
    assert parts[1].startswith(parts[0].split("\n\n")[-1])
    assert {w for p in parts for w in p.split()} == {f"p{i}w{j}" for i, n in enumerate((40, 30, 45, 10, 300)) for j in range(n)}


def test_merge_short_neighbours():
    pieces = [structure.Piece(("d", "A"), "w " * 50), structure.Piece(("d", "A", "x"), "w " * 20), structure.Piece(("d", "B"), "w " * 130)]
    got = structure.merge(pieces, lambda s: len(s.split()))
    assert [p.path for p in got] == [("d", "A"), ("d", "B")] and got[0].text == "w " * 50 + "\nx\n" + "w " * 20


def test_a_descendant_or_sister_changes_no_parent():
    words = lambda s: len(s.split())
    piece = lambda n, *path: structure.Piece(("d", *path), "w " * n)
    paths = lambda *pieces: [p.path for p in structure.merge(list(pieces), words)]
    assert paths(piece(70, "A", "B"), piece(30, "A", "B", "C")) == [("d", "A", "B")]
    assert paths(piece(70, "A", "B"), piece(30, "A", "C")) == [("d", "A")]
    assert paths(piece(70, "A", "B", "C"), piece(30, "A", "D")) == [("d", "A", "B", "C"), ("d", "A", "D")]
    assert paths(piece(50, "A", "B", "C"), piece(30, "A", "D")) == [("d", "A")]
    assert structure.with_paths("d", [structure.Section(1, "A", ""), structure.Section(2, "B", "x")]) == [structure.Piece(("d", "A", "B"), "x")]


def test_seeds_and_violations(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("nome: A\nano_fundacao: 2020\ncoletado_em: 2024-01-02\ngabarito: {classe: x}\ndocumentos:\n" + "".join(f"- {{tipo: {t}, titulo: t, url_fonte: 'https://x/{i}', conteudo_texto: '{'w' * 200}'}}\n" for i, t in enumerate(("site", "blog", "site"))))
    (tmp_path / "b.yaml").write_text("nome: B\ndocumentos: [{tipo: odd, titulo: t, url_fonte: ftp, conteudo_texto: short}]\n")
    seeded = files.seeds(spark, f"file://{tmp_path}")
    assert [(r.nome, r.ano_fundacao) for r in files.entities(seeded).collect()] == [("A", 2020), ("B", None)] and files.documents(seeded).count() == 4
    bad = files.violations(seeded, "file", files.seed_checks()).collect()
    assert {r.file for r in bad} == {"b.yaml"} and len(bad) == 5


def test_runs_skip_broken_files(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"id": "1", "gerado_em": "2024-01-01"}')
    (tmp_path / "2.json").write_text('{"id": "2", "gerado_em": "2024-02-01"}')
    (tmp_path / "3.json").write_text("{broken")
    assert [r.id for r in files.runs(spark, f"file://{tmp_path}", "id string, gerado_em string").collect()] == ["2", "1"]


def test_curated_lists(spark, tmp_path):
    (tmp_path / "q.yaml").write_text("perguntas:\n- {id: q1, pergunta: a, tipo: geral, url_esperada: u, frase_ancora: x}\n- {id: q2, tipo: sem_resposta, url_esperada: u}\n- {id: q3, tipo: geral}\n")
    questions = files.curated(spark, f"file://{tmp_path}/q.yaml", files.QUESTIONS, "perguntas")
    assert [(r.place, r.id) for r in questions.orderBy("place").collect()] == [(0, "q1"), (1, "q2"), (2, "q3")]
    bad = files.violations(questions, "id", files.question_checks()).collect()
    assert sorted((r.id, r.reason) for r in bad) == [("q2", "unanswerable with an address"), ("q2", "unanswerable without a reason"), ("q3", "no address or anchor")]
    (tmp_path / "m.yaml").write_text("- {tecnologia: t, url_fetch: f, url_citacao: c, formato: html, chars_medidos: 9}\n")
    assert files.curated(spark, f"file://{tmp_path}/m.yaml", files.MANIFEST).first().chars_medidos == 9
    cases = spark.createDataFrame([("a", True), ("a", False), ("b", True), ("typo", True)], "rotulo string, exclui boolean")
    assert sorted((r.rotulo, r.reason) for r in files.exclusion_problems(cases, ["a", "b"]).collect()) == [("b", "one side only"), ("typo", "unknown label")]


def test_report(spark):
    rows = spark.createDataFrame([("b", "media"), ("a", "media"), ("c", "alta"), ("d", None)], "name string, priority string")
    assert report.ordered(rows, "name") == [("c", "alta"), ("a", "media"), ("b", "media"), ("d", "none")]
    assert "nothing in the data" in report.render("q", "s", [])
    row = {"name": "n", "class": "c", "quadrant": "q", "priority": "alta", "evidence": ["e"]}
    text = report.render("q", "s", [row | {"excluded": ["age"]}, row | {"name": "m", "unverified": ["site"]}], discriminates=False)
    assert text.index("m:") < text.index("n:") and "not eligible: age" in text and "to be checked: site" in text and "no filter" in text


def test_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(f"file://{tmp_path}/in")
    stream = progress.windowed(progress.read_events(spark, f"file://{tmp_path}/in"), late="3650 days")
    run = stream.writeStream.outputMode("complete").format("memory").queryName("progress_counts").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(spark.sql("select * from progress_counts").collect()) == sorted(progress.windowed(events).collect())
