"""hOCR words and whole GraphML documents."""

import glob
import xml.etree.ElementTree as ET

from spanweave.sources import documents
from spanweave.workspace import Workspace

PAGE = """<div class='ocr_page' id='page_1' title='bbox 0 0 9 9'><p class='ocr_par' lang='deu'>
<span class='ocr_line' title="bbox 1 1 8 2"><span class='ocrx_word' id='w1' title='bbox 1 2 30 40; x_wconf 93'>Gr&amp;n</span>
<span class='ocrx_word' id='w2' title='bbox 31 2 60 40; x_wconf 88.5'><strong>fett</strong></span> <span class='ocrx_word' title='bbox 0 0 1 1'> </span></span></p>
<p class="ocr_par"><span class="ocrx_word" title="bbox 5 6 7 8">&lt;b&gt;</span></p></div><div class='ocr_page'><p class='ocr_par'><span class='ocrx_word' title='bbox 1 1 2 2; x_wconf 5'>neu</span></p></div>"""


def test_hocr_words(spark):
    files = spark.createDataFrame([(1, PAGE), (2, "<html>no words</html>"), (3, None)], "doc_id int, text string")
    got = [(r.doc_id, r.page, r.para, r.x0, r.y0, r.x1, r.y1, r.conf, r.word) for r in documents.parse_hocr(files).orderBy("n").collect()]
    assert got == [(1, 1, 1, 1, 2, 30, 40, 93.0, "Gr&n"), (1, 1, 1, 31, 2, 60, 40, 88.5, "fett"), (1, 1, 2, 5, 6, 7, 8, None, "<b>"), (1, 2, 3, 1, 1, 2, 2, 5.0, "neu")]


def test_parts_of_graphml_are_one_document(spark, tmp_path):
    nodes = spark.createDataFrame([(f"n{i}", f"<{i}> & more") for i in range(300)], "id string, label string")
    edges = spark.createDataFrame([(f"n{i}", f"n{i * 7 % 300}", None if i % 5 else "x") for i in range(300)], "source string, target string, label string")
    documents.write_graphml(nodes, edges, str(tmp_path / "g"), parts=5)
    files = sorted(glob.glob(str(tmp_path / "g/part-*")))
    root = ET.fromstring("".join(open(f).read() for f in files).encode())
    space = {"g": "http://graphml.graphdrawing.org/xmlns"}
    graph = root.find("g:graph", space)
    assert len(files) > 1 and graph.get("edgedefault") == "directed"
    assert {n.get("id"): n.find("g:data", space).text for n in graph.findall("g:node", space)} == {f"n{i}": f"<{i}> & more" for i in range(300)}
    assert len(graph.findall("g:edge", space)) == 300
    documents.write_graphml(nodes.limit(0), edges.limit(0), str(tmp_path / "empty"))
    assert ET.fromstring("".join(open(f).read() for f in sorted(glob.glob(str(tmp_path / "empty/part-*")))).encode()).find("g:graph", space) is not None


def test_tables_go_with_the_application(spark):
    space = Workspace(spark, "gone")
    space.write(spark.range(3), "t")
    path = spark._jvm.org.apache.hadoop.fs.Path(space.root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.exists(path) and fs.cancelDeleteOnExit(path)
    fs.deleteOnExit(path)
