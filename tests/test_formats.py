"""Codecs, readers, writers and the planner, without Spark."""

import random
import time

import pyarrow as pa
import pytest

from quillstream.errors import ConfigError, NoRouteError
from quillstream.model import FIELDS, make
from quillstream.plans import config, graph
from quillstream.plans.convert import convert, one_hop, plan, read
from quillstream.sources import columns, containers, markup, palm

BLOCKS = [make("heading", data="One & <two>", level=1), make("paragraph", data="Text \"q\" é☃"), make("heading", data="Deep", level=2), make("paragraph", data="More"), make("heading", data="Next", level=1), make("paragraph", data="End")]
PAIRS = [(b["type"], b["data"]) for b in BLOCKS]


def pairs(doc):
    return [(b["type"], b["data"]) for b in doc["content"]]


def test_palm_codec_round_trips():
    rng = random.Random(3)
    for x in [b"", b"a", "é☃é".encode() * 30, bytes(range(256)) * 2, b"XYZ" * 40, *[bytes(rng.choice(b"ab \x01\xc3\xa9") for _ in range(2000)) for _ in range(5)]]:
        assert palm.decompress(palm.compress(x)) == x


@pytest.mark.parametrize("n,code", [(0, "80"), (1, "81"), (127, "ff"), (128, "0180"), (300, "02ac")])
def test_vwi(n, code):
    assert palm.vwi(n).hex() == code


def test_base32_and_fdst():
    assert [palm.base32(k) for k in (0, 1, 31, 32, 1048576)] == ["0000", "0001", "000V", "0010", "10000"]
    assert palm.fdst(5000) == b"FDST" + bytes.fromhex("0000000c000000010000000000001388")


def test_split_utf8_parts_no_character():
    parts = palm.split_utf8(b"A" * 4095 + "☃".encode() + b"B")
    assert [len(p) for p in parts] == [4095, 4] and all(p.decode() for p in parts)
    assert palm.split_utf8(b"") == [b""]


def test_books_come_back():
    meta = {"title": "T & <x>", "author": "A"}
    assert pairs(palm.read_palm(palm.write_mobi(meta, BLOCKS))) == PAIRS
    got = palm.read_palm(palm.write_azw3(meta, BLOCKS, "s"))
    assert pairs(got) == PAIRS and got["metadata"] == {"author": "A", "title": "T & <x>"}
    assert pairs(containers.read_fb2(containers.write_fb2(meta, BLOCKS))) == PAIRS
    got = containers.read_epub(containers.write_epub(meta, BLOCKS))
    assert pairs(got) == PAIRS and got["metadata"]["title"] == "T & <x>"
    assert pairs(containers.read_docx(containers.write_docx(meta, BLOCKS))) == PAIRS
    assert containers.write_epub(meta, BLOCKS) == containers.write_epub(meta, BLOCKS)


def test_epub_pairs_titles_by_position():
    parts = containers.chapters_of([make("paragraph", data="before"), make("heading", data="A", level=1), make("heading", data="B", level=1)])
    assert parts == [("A", "<p>before</p>"), ("B", "<h1>A</h1>")]
    assert containers.chapters_of([]) == [("Content", "<p>No content</p>")]


def test_mobi_page_breaks_and_contents():
    html, toc = palm.mobi_html(BLOCKS)
    assert html.count("<mbp:pagebreak/>") == 1 and [x["label"] for x in toc] == ["One & <two>", "Next"]
    raw = html.encode()
    assert raw[toc[0]["offset"] :].startswith(b"<h1>One") and toc[-1]["offset"] + toc[-1]["length"] == len(raw)


def test_docx_tables_lists_and_runs():
    blocks = [make("run", data="bold", bold=True, color="#FF0000", size=12), make("list", items=["a", "b"], ordered=False), make("table", headers=["h", "i"], rows=[["1", "2"]])]
    got = containers.read_docx(containers.write_docx({}, blocks, "s"))["content"]
    assert [b["type"] for b in got] == ["run", "table"]  # list paragraphs are skipped
    assert got[0]["bold"] and got[0]["color"] == "#ff0000" and got[0]["size"] == 12 and got[1]["rows"] == [["1", "2"]]


def test_pdf_text_comes_back():
    got = containers.read_pdf(containers.write_pdf({"title": "T (x)"}, BLOCKS))
    assert got["metadata"]["title"] == "T (x)" and "More" in got["content"][0]["data"]
    long = [make("paragraph", data="word " * 300)] * 8
    assert len(containers.read_pdf(containers.write_pdf({}, long))["content"]) > 1
    lines = containers.read_pdf(containers.write_pdf({}, BLOCKS), by_line=True)["content"]
    assert [b["data"] for b in lines][1:2] == ['Text "q" é?']


def test_pdf_object_streams_fonts_with_maps_and_gaps():
    import zlib

    cmap = b"1 beginbfchar <0001> <0041> endbfchar 2 beginbfrange <0002> <0003> <00420042> <0004> <0005> [<2603> <00e9>] endbfrange"
    page = b"BT /G 12 Tf 1 0 0 1 72 700 Tm <00010002> Tj 0 -14 Td [<0004> -300 <0005>] TJ /H 9 Tf T* (plain (x) \\\\ \\101) Tj ET"
    inside = [(1, b"<</Type/Catalog/Pages 2 0 R>>"), (2, b"<</Type/Pages/Count 1/Kids[3 0 R]/Resources<</Font 6 0 R>>>>"), (3, b"<</Type/Page/Parent 2 0 R/Contents 7 0 R>>"), (4, b"<</Type/Font/ToUnicode 8 0 R>>"), (5, b"<</Type/Font>>"), (6, b"<</G 4 0 R/H 5 0 R>>")]
    places, text = [], b""
    for k, o in inside:
        places += [k, len(text)]
        text += o + b" "
    lead = b" ".join(b"%d" % x for x in places) + b" "
    packed = zlib.compress(lead + text)
    stream = lambda k, head, body: b"%d 0 obj<<%s/Length %d>>stream\n%s\nendstream endobj\n" % (k, head, len(body), body)
    data = b"%PDF-1.5\n" + stream(9, b"/Type/ObjStm/N 6/First %d/Filter/FlateDecode" % len(lead), packed) + stream(7, b"/Filter/FlateDecode", zlib.compress(page)) + stream(8, b"", cmap)
    assert [b["data"] for b in containers.read_pdf(data)["content"]] == ["ABB\n☃ é\nplain (x) \\ A"]


def test_pdf_numbers_take_time_in_proportion():
    """Neither long digits nor the gaps between text are looked at from each of their places."""
    began = time.perf_counter()
    digits = b"1" * 60000
    with pytest.raises(ValueError):
        containers.read_pdf(b"%PDF-1.4\n" + digits)
    assert containers._pdf_text(b"[(a) " + digits + b" (b) -300 (c) 5-201 (d) -200 (e) 300 (f)] TJ", {}) == "ab c def"
    assert time.perf_counter() - began < 2


def test_blocks_of_arrow_are_those_of_to_pylist():
    kind = pa.list_(pa.struct([(n, pa.list_(pa.list_(pa.string())) if n == "rows" else pa.list_(pa.string()) if n in ("headers", "items") else pa.int32() if n in ("level", "size") else pa.bool_() if n in ("bold", "italic", "underline", "ordered") else pa.string()) for n in FIELDS]))
    table, heading = make("table", headers=[], rows=[["a", None], None]), make("heading", data="x", level=1)
    rows = [[heading], None, [], [make("list", items=["a"], ordered=False), table], [heading] * 3, [make("paragraph", data=None)]]
    for given in (rows, [*rows, [None, heading]], [], [None], [[]], [[make("paragraph", data="é")]]):
        whole = pa.array(given, kind)
        for at in range(len(given) + 1):
            part = whole.slice(at, 3)
            assert columns.blocks_of(part) == part.to_pylist() == given[at : at + 3]


def test_rtf_text():
    coded = r"{\rtf1{\fonttbl x;}\b Bold\b0  a\par \'e9" + chr(92) + r"u9731? \{x\}}"
    assert containers.rtf_text(coded) == "Bold a\n\u00e9\u2603 {x}"


def test_html_nested_paragraphs_and_title():
    doc = markup.read_html("<title> T </title><body><h1></h1><p>a<p>b</p><script>x</script><p> </p>")
    assert doc["metadata"] == {"title": "T"} and pairs(doc) == [("heading", ""), ("paragraph", "ab"), ("paragraph", "b")]
    assert markup.read_html("<h1>Title</h1><p>Content</p>")["metadata"] == {"title": "Title"}
    rich = markup.read_html("<table><thead><tr><th>a</th></tr></thead><tbody><tr><td>1</td></tr></tbody></table><ol><li>x</li></ol>", rich=True)["content"]
    assert rich[0]["headers"] == ["a"] and rich[0]["rows"] == [["1"]] and rich[1]["ordered"] and rich[1]["items"] == ["x"]


def test_markdown_blocks():
    doc = markup.read_markdown("# Test Document\n\nThis is a **test** [doc](u).\n\n## Section 1\n\n- a\n- b\n\nUnder\n---\n\n    code\n")
    assert [(b["type"][0], b["data"], b["level"]) for b in doc["content"]] == [("h", "Test Document", 1), ("p", "This is a test doc.", None), ("h", "Section 1", 2), ("h", "Under", 2)]


def test_odt():
    import io
    import zipfile

    t, o = containers.TEXT, containers.OFFICE
    content = f'<o:document xmlns:o="{o}" xmlns:t="{t}"><o:body><o:text><t:h t:outline-level="2">H</t:h><t:p>p<t:span>q</t:span></t:p><t:p t:style-name="Heading_20_3">S</t:p></o:text></o:body></o:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("content.xml", content)
    got = containers.read_odt(out.getvalue())["content"]
    assert [(b["type"], b["data"], b["level"]) for b in got] == [("heading", "H", 2), ("paragraph", "pq", None), ("heading", "S", 2)]


def test_every_pair_has_a_route_and_runs():
    src = {"txt": b"A\n\nB", "md": b"# A\n\nB", "html": b"<h1>A</h1><p>B</p>"}
    for s in src:
        for t in ("epub", "fb2", "mobi", "azw3", "pdf"):
            out = src[s]
            for a, b in zip(plan(s, t), plan(s, t)[1:]):
                out = one_hop(out, a, b, "stem", {})
            assert out and "B" in " ".join(x["data"] or "" for x in read(t, out, "txt")["content"])
    assert plan("azw3", "epub") == ["azw3", "txt", "epub"] and plan("md", "md") is None and plan("txt", "txt") == ["txt", "txt"] and plan("xyz", "abc") is None


def test_html_to_docx_fails_as_documented():
    with pytest.raises(NoRouteError):
        one_hop(b"<p>x</p>", "html", "docx", "s", {})
    assert one_hop(b"<p>x</p>", "html", "docx", "s", {"html_to_rich": True})


def test_config_layers(tmp_path):
    assert config.DEFAULTS["output"]["filename_pattern"] == "{name}.{ext}"
    (tmp_path / config.FILE).write_text("documents:\n  encoding: latin-1\n")
    (tmp_path / "bad.yaml").write_text("- a\n")
    with pytest.raises(ConfigError):
        config.load(tmp_path / "bad.yaml")
    c = config.Config({"output": {"directory": "u"}}, {"output": {"overwrite": True}})
    src = tmp_path / "a" / "b.txt"
    assert c.get("documents.encoding", source=src) == "latin-1" and c.get("documents.encoding") == "utf-8"
    assert c.get("output.directory") == "u" and c.get("output.overwrite") is True and c.get("no.such", 5) == 5


def test_convert_gives_errors_as_rows(spark):
    files = spark.createDataFrame([("/d/a.txt", bytearray(b"A\n\nB")), ("/d/b.docx", bytearray(b"junk")), ("/d/c.zzz", bytearray(b"")), ("/d/n.txt", None)], "path string, data binary")
    rows = {r["result"]["source_path"]: r for r in convert(files, ["html"], existing=spark.createDataFrame([("/d/x.html",)], "path string")).collect()}
    assert rows["/d/a.txt"]["result"]["success"] and bytes(rows["/d/a.txt"]["output"]).endswith(b"<p>B</p>\n</body>\n</html>")
    assert rows["/d/a.txt"]["result"]["target_path"] == "/d/a.html"
    assert [rows[p]["result"]["success"] for p in ("/d/b.docx", "/d/c.zzz", "/d/n.txt")] == [False] * 3
    assert rows["/d/b.docx"]["result"]["target_path"] == "/d/b.html" and rows["/d/c.zzz"]["result"]["target_path"] is None and rows["/d/c.zzz"]["result"]["hops"] == 0
    taken = convert(files.filter("path = '/d/a.txt'"), ["html"], existing=spark.createDataFrame([("/d/a.html",)], "path string")).first()
    assert not taken["result"]["success"] and "exists" in taken["result"]["error"]


def test_the_two_writers_of_text_agree(spark):
    """What runs in Catalyst and what runs within a chain of hops render the same."""
    from pyspark.sql import functions as F

    from quillstream.operators import render
    from quillstream.plans.convert import _rtf, _text_page

    blocks = [*BLOCKS, make("text", data="plain"), make("table", headers=["h"], rows=[["1"], ["2"]]), make("list", items=["a", "b"], ordered=True), make("list", items=["c"], ordered=False)]
    for meta in ({}, {"title": "T & 'x'", "author": "A<b>"}):
        df = spark.createDataFrame([(meta, blocks)], "metadata map<string,string>, content array<struct<" + ",".join(f"{k}:{v}" for k, v in FIELDS.items()) + ">>")
        m, c = F.col("metadata"), F.col("content")
        for family, style in render.STYLES.items():
            row = df.select(render.txt(m, c, family).alias("txt"), render.html(m, c, family).alias("html"), render.md(m, c, family).alias("md")).first()
            for target in ("txt", "html", "md"):
                assert row[target] == _text_page({"metadata": meta, "content": blocks}, style, target), (family, target)
        assert df.select(render.rtf(m, c).alias("x")).first()["x"] == _rtf({"metadata": meta, "content": blocks})


def test_plain_text_in_catalyst_gives_what_the_chain_gives(spark):
    texts = ["A\n\n B & <c> \n\n\n'q' \\{x}", "", "\r\na\rb\r\n\r\nc", "é☃", "\x0bx\x1c"]
    files = spark.createDataFrame([(f"/d/{k}.txt", bytearray(t.encode())) for k, t in enumerate(texts)] + [("/d/bad.txt", bytearray(b"\xff\xfe"))], "path string, data binary")
    for target in ("txt", "html", "md", "rtf"):
        for r in convert(files, [target]).collect():
            k = r["result"]["source_path"][3:-4]
            if k == "bad":
                assert not r["result"]["success"] and "decode" in r["result"]["error"]
            else:
                assert bytes(r["output"]) == one_hop(texts[int(k)].encode(), "txt", target, "s", {}), (k, target)


def test_settings_of_each_file_and_intermediate_files(spark):
    files = spark.createDataFrame([("/d/a.md", bytearray(b"# A\n\nB")), ("/d/sub/b.md", bytearray(b"C")), ("/d/sub/deep/c.txt", bytearray(b"C"))], "path string, data binary")
    got = convert(files, ["azw3", "html"], config={"documents.encoding": "utf-8"}, directories={"/d": {"output.filename_pattern": "{name}-x.{ext}"}, "/d/sub": {"output.directory": "/out/", "documents.title_from_filename": True}}, overrides={"output.overwrite": True}, keep_intermediate=True)
    rows = {(r["result"]["source_path"], r["result"]["target_path"]): r for r in got.collect()}
    assert set(rows) == {(f"/d/{s}", f"{o}.{e}") for s, o in (("a.md", "/d/a-x"), ("sub/b.md", "/out/b"), ("sub/deep/c.txt", "/out/c")) for e in ("azw3", "html")}
    assert palm.read_palm(bytes(rows["/d/sub/b.md", "/out/b.azw3"]["output"]))["metadata"]["title"] == "b"
    multi = convert(spark.createDataFrame([("/d/a.htm", bytearray(b"<p>x</p>"))], "path string, data binary"), ["epub"], keep_intermediate=True).first()
    assert [(x["path"], bytes(x["data"])) for x in multi["intermediates"]] == [("/d/a_intermediate.txt", b"x\n\n")]


def test_registered_converters_run_on_workers(spark):
    before = list(graph.CONVERTERS)
    try:
        assert graph.register("shout", ["loud"], [".txt"], lambda data, src, dst, stem, cfg: data.upper())
        assert not graph.register("never", ["a"], ["b"], None, requires=("no_such_module_at_all",))
        files = spark.createDataFrame([("/d/a.loud", bytearray(b"hey"))], "path string, data binary")
        rows = {r["result"]["target_path"]: r for r in convert(files, ["txt", "html"]).collect()}
        assert bytes(rows["/d/a.txt"]["output"]) == b"HEY" and b"<p>HEY</p>" in bytes(rows["/d/a.html"]["output"]) and rows["/d/a.html"]["result"]["hops"] == 2
    finally:
        graph.restore(before)
    assert plan("loud", "txt") is None


def test_api_and_command_line(spark, tmp_path, capsys, monkeypatch):
    import quillstream
    from quillstream.cli import main

    monkeypatch.setattr("pathlib.Path.home", lambda: tmp_path / "home")
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a b+c.txt").write_text("A\n\nB")
    (tmp_path / "in" / "sub" / "d.md").write_text("# T\n\nx")
    (tmp_path / "in" / "sub" / config.FILE).write_text("output:\n  filename_pattern: '{name}_new.{ext}'\n")
    assert quillstream.convert(tmp_path / "in" / "a b+c.txt", "md") and (tmp_path / "in" / "a b+c.md").read_text() == "A\n\nB\n\n"
    assert not quillstream.convert(tmp_path / "in" / "a b+c.txt", "md") and quillstream.convert(tmp_path / "in" / "a b+c.txt", "md", overwrite=True)
    assert not quillstream.convert(tmp_path / "none.txt", "md")
    main([str(tmp_path / "in" / "a b+c.txt"), str(tmp_path / "in" / "sub" / "d.md"), "-f", "html,azw3", "-o", str(tmp_path / "out"), "-v", "--keep-intermediate"])
    said = capsys.readouterr().out
    assert "4 converted, 0 failed" in said and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a b+c.azw3", "a b+c.html", "d_new.azw3", "d_new.html"]
    main(["--init-config"])
    assert config.load(tmp_path / "home" / config.USER) == config.DEFAULTS
    assert quillstream.extract_metadata((tmp_path / "out" / "d_new.azw3").read_bytes(), "azw3")["title"] == "d"


def test_covers_pass_through():
    jpeg = b"\xff\xd8\xff\xe0" + bytes(100)
    for book in (palm.write_mobi({}, BLOCKS, images={"cover": {"data": jpeg}}), palm.write_azw3({}, BLOCKS, "s", images={"cover": {"data": jpeg}})):
        records = palm.records_of(book)
        zero = records[0]
        assert records[int.from_bytes(zero[108:112], "big")] == jpeg and bytes.fromhex("000000c90000000c00000000") in zero
        assert pairs(palm.read_palm(book)) == PAIRS
    assert palm.cover_records({"cover": {"data": b"\x89PNG"}}) == [] and palm.cover_records(None) == []


def png(wide, high):
    import struct
    import zlib

    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + bytes((k, 128, 255 - k)) * wide for k in range(high))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", wide, high, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_pictures_go_into_documents(spark):
    import io
    import zipfile
    from xml.etree import ElementTree as ET

    jpeg = b"\xff\xd8\xff\xe0\x00\x10JFIF" + bytes(10) + b"\xff\xc0\x00\x11\x08\x00\x20\x00\x40\x03" + bytes(9) + b"\xff\xd9"
    assert containers.picture_size(jpeg) == ("jpeg", 64, 32) and containers.picture_size(png(3, 2)) == ("png", 3, 2) and containers.picture_size(b"GIF89a") is None
    images = {"a": {"data": jpeg}, "b": {"data": png(3, 2)}, "c": {"data": b"GIF89a"}}
    blocks = [make("paragraph", data="x"), *[make("image", name=n) for n in ("a", "b", "c", "none")], make("paragraph", data="y")]
    with zipfile.ZipFile(io.BytesIO(containers.write_docx({}, blocks, "s", images=images))) as z:
        assert {n: z.read(n) for n in z.namelist() if "media" in n} == {"word/media/image1.jpeg": jpeg, "word/media/image2.png": png(3, 2)}
        links = [e.get("Target") for e in ET.fromstring(z.read("word/_rels/document.xml.rels"))]
        body = z.read("word/document.xml").decode()
    assert links == ["styles.xml", "media/image1.jpeg", "media/image2.png"] and body.count("<pic:pic ") == 2 and 'cx="3657600" cy="1828800"' in body
    pdf = containers.write_pdf({}, blocks, images=images)
    objects = containers._pdf_objects(pdf)
    assert objects[5][1] == jpeg and b"/Width 3/Height 2" in objects[6][0] and b"/P1 6 0 R" in pdf
    assert containers.read_pdf(pdf)["content"][0]["data"] == "x\ny"
    df = spark.createDataFrame([(1, {}, blocks, {"a": (jpeg,)})], "k int, metadata map<string,string>, content array<struct<" + ",".join(f"{k}:{v}" for k, v in FIELDS.items()) + ">>, images map<string,struct<data:binary>>")
    from quillstream.sources import columns

    out = bytes(columns.write_documents(df, "docx", keep=("k",)).first()["output"])
    assert zipfile.ZipFile(io.BytesIO(out)).read("word/media/image1.jpeg") == jpeg


def test_ids_stay_exact_beside_nulls(spark):
    from quillstream.sources import columns

    ids = [2**53 + 1, None, 2**53 + 3]
    files = spark.createDataFrame([(i, bytearray(b"<p>x</p>")) for i in ids] + [(5, None)], "k long, data binary")
    docs = columns.read_documents(files.coalesce(1), "html", keep=("k",))
    assert [r["k"] for r in docs.collect()] == [*ids, 5] and docs.filter("k = 5").first()["error"] == "no data"
    assert [r["k"] for r in columns.write_documents(docs, "fb2", keep=("k",)).collect()] == [*ids, 5]


def test_kf8_layout():
    records = palm.records_of(palm.write_azw3({"title": "T x", "language": "en-GB"}, BLOCKS, "s"))
    at = lambda k: int.from_bytes(records[0][k : k + 4], "big")
    assert (at(0x14), at(0x24), at(0x68), at(0x80), at(0xF0)) == (264, 8, 8, 0x40, 1) and records[0][280:284] == b"EXTH"
    assert [records[at(k)][:4] for k in (0xC0, 0xC8, 0xD0, 0xF4, 0xF8, 0xFC, 0x104)] == [b"FDST", b"FCIS", b"FLIS", *[b"INDX"] * 4]
    assert len(records[at(0xC8)]) == 52 and records[-1] == palm.EOF and b"text" in records[at(0x104) + 1]


def test_stream_converts_what_arrives(spark, tmp_path):
    from quillstream.streaming.files import convert_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("A\n\nB")
    convert_stream(spark, f"file://{tmp_path}/in", ["md"], f"file://{tmp_path}/out", f"file://{tmp_path}/ck").awaitTermination(60)
    row = spark.read.parquet(f"file://{tmp_path}/out").first()
    assert row["result"]["success"] and bytes(row["output"]) == b"A\n\nB\n\n"


def test_graph_matches_search(spark):
    for r in graph.paths(spark, 2).collect():
        if r["src"] != r["dst"]:
            assert r["path"] == graph.find_path(r["src"], r["dst"])


def test_archives_are_those_of_zipfile():
    import io
    import zipfile

    files = [("mimetype", "abc", False), ("a/b.xml", "é☃" * 5000, True), ("c", b"\0" * 10, True), ("e", "", True)]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data, packed in files:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED if packed else zipfile.ZIP_STORED)
    made = containers._zip(files)
    assert made == out.getvalue()
    with zipfile.ZipFile(io.BytesIO(made)) as z:
        take = containers._taker(z, made)
        assert [take(name) for name, _, _ in files] == [z.read(name) for name, _, _ in files]
        broken = bytearray(made)
        broken[z.getinfo("a/b.xml").header_offset + 40] ^= 0xFF
    with zipfile.ZipFile(io.BytesIO(bytes(broken))) as z, pytest.raises((zipfile.BadZipFile, __import__("zlib").error)):
        containers._taker(z, bytes(broken))("a/b.xml")


def test_python_passes_take_small_runs_and_no_text_that_is_made(spark):
    import pyarrow as pa

    from quillstream.sources import columns

    assert list(columns.slices(pa.array([b"x"] * 1100))) == [(0, 500), (500, 500), (1000, 100)]
    assert list(columns.slices(pa.array([b"x" * 60, None, b"y" * 60, b"z" * 200]), size=100)) == [(0, 2), (2, 1), (3, 1)]
    files = spark.createDataFrame([("/in/a.txt", b"one")], "path string, data binary")
    plan = convert(files, ["html"])._jdf.queryExecution().toString()
    assert "ArrowEvalPython" in plan and "MapInPandas" not in plan
