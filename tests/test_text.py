import unicodedata

from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.functions.arrays import cosine, finite, keep_first, keep_last, l2_normalize, xy_pair

C = F.col


def test_templates(spark):
    qa = spark.createDataFrame([("q", "a")], "question string, answer string")
    assert qa.select(T.qa_text(qa)).first()[0] == "Q:\nq\n\nA:\na"
    half = qa.drop("answer")
    assert half.select(T.qa_text(half)).first()[0] == "Q:\nq\n\nA:\n"
    both = qa.withColumn("text", F.lit("t"))
    assert both.select(T.qa_text(both)).first()[0] == "t"
    code = spark.createDataFrame([("p", "c", "s")], "prompt string, code string, solution string")
    assert code.select(T.code_text(code)).first()[0] == "# Prompt\np\n\n# Solution\nc"
    solved = code.drop("code")
    assert solved.select(T.code_text(solved)).first()[0] == "# Prompt\np\n\n# Solution\ns"


def test_choice_prompt(one):
    rows = [("q", ["x", "y"])]
    def ask(style):
        return one(lambda d: T.mcq_prompt(C("q"), C("c"), style), rows, "q string, c array<string>")[0]
    assert ask("en") == "q\nA. x\nB. y\nAnswer:"
    assert ask("tr") == "q\nA. x\nB. y\nCevap:"
    assert ask("full") == "Question: q\nA. x\nB. y\nAnswer: "


def test_labels(one):
    rows = [([],), (["x"] * 5,)]
    assert one(lambda d: T.labels(C("c")), rows, "c array<string>") == [[], list("ABCDE")]
    assert one(lambda d: T.labels(C("c"), 4), rows, "c array<string>") == [[], list("ABCD")]


def test_gold_parse(one):
    rows = [(v,) for v in ("A", " b ", "2", "E", "x", None, "-1", "07", "é")]
    assert one(lambda d: T.parse_gold(C("a")), rows, "a string") == [0, 1, 2, 4, None, None, -1, 7, None]


def test_numbers(one):
    rows = [(v,) for v in (
        "so #### 42 or 43", "#### 1,234", "a 3 b -4.50", "none", "#### -3.50", "#### .5", "#### ١٢")]
    assert one(lambda d: T.extract_number(C("t")), rows, "t string") == [
        "42", "1", "-4.50", None, "-3.50", "5", "١٢"]
    assert one(lambda d: T.last_number(C("t")), rows, "t string") == [
        "43", "234", "-4.50", None, "-3.50", "5", "١٢"]
    assert one(lambda d: T.extract_number(C("t"), True), rows, "t string")[1] == "1234"
    assert one(lambda d: T.gold_number(C("t")), rows[:6], "t string") == [42.0, 1.0, -4.5, None, -3.5, 0.5]


def test_cues(one):
    rows = [(v,) for v in (
        "cevap: 5 son 9", "SONUÇ: 5 ve 7", "toplam 4 cevap 3", "2 + 2 = 4 olur 8", "7 TL 1", "7 lira 1",
        "3 kilogram 1", "3 metre 1", "3 saat 1", "3 dakika 1", "1 2 3", "yok", "cevap 1 cevap 2", "#### 6 cevap 5",
        "cevap .5")]
    assert one(lambda d: T.cue_number(C("t")), rows, "t string") == [
        5, 5, 3, 4, 7, 7, 3, 3, 3, 3, 3, None, 2, 6, 0.5]


def test_answers_match(one):
    rows = [("5", " 5"), (None, "0"), ("5", "5.0")]
    assert one(lambda d: T.answers_match(C("p"), C("g")), rows, "p string, g string") == [True, False, False]
    rows = [(None, 0.0), (5.0, 5.0000001), (None, 1.0)]
    assert one(lambda d: T.answers_match(C("p"), C("g"), "number"), rows, "p double, g double") == [True, True, False]


def test_contexts(one):
    rows = [(" a ", None), ("a", " b ")]
    schema = "a string, b string"
    assert one(lambda d: T.ending_context(C("a"), C("b")), rows, schema) == ["a ", "a  b "]
    assert one(lambda d: T.ending_context(C("a"), C("b"), "joined"), rows, schema) == [" a ", "a b "]
    asked = [("\u00a0 q \x1c",)]
    assert one(lambda d: T.numeric_prompt(C("q")), asked, "q string") == ["q\nAnswer:"]
    assert one(lambda d: T.numeric_prompt(C("q"), "question"), asked, "q string") == ["Question: q\nAnswer:"]
    assert one(lambda d: T.numeric_prompt(C("q"), "tr"), asked, "q string") == ["Soru: \u00a0 q \x1c\n\nÇözüm:"]


def test_generated_text(one):
    rows = [("x = 1\nclass A:\n# End",), ("\n\n\nx",), ("plain",), ("a\n# End\nclass B",)]
    assert one(lambda d: T.cut_at(C("t")), rows, "t string") == ["x = 1", "", "plain", "a"]
    rows = [("ask: yes ", "ask:"), ("no ask:", "ask:"), ("a.c x", "a.c")]
    assert one(lambda d: T.strip_echo(C("t"), C("p")), rows, "t string, p string") == ["yes", "no ask:", "x"]
    rows = [("x" * 200,), ("x" * 201,)]
    assert one(lambda d: T.preview(C("t")), rows, "t string") == ["x" * 200, "x" * 200 + "..."]


def test_names_and_labels(one):
    rows = [("org/model",)]
    assert one(lambda d: T.model_to_dir(C("m")), rows, "m string") == ["org__model"]
    assert one(lambda d: T.dir_to_model(T.model_to_dir(C("m"))), rows, "m string") == ["org/model"]
    assert one(lambda d: T.lang_head(C("l")), [("eng-Latn",), ("en",)], "l string") == ["eng", "en"]
    assert one(lambda d: T.fmt(C("x"), 2), [(1.236,), (3.0,)], "x double") == ["1.24", "3.00"]
    assert one(lambda d: T.fmt(C("x"), 0, thousands=True), [(1234567,)], "x bigint") == ["1,234,567"]


def test_sequence_normaliser(one):
    texts = ["``a''", "é  ﬁ   x", "Ａ①", None, "ñ\n  b"]
    def plain(t):
        if t is None:
            return None
        t = unicodedata.normalize("NFKD", t.replace("``", '"').replace("''", '"'))
        t = "".join(c for c in t if unicodedata.category(c) != "Mn")
        while "  " in t:
            t = t.replace("  ", " ")
        return t
    got = one(lambda d: T.normalize_text(C("t")), [(t,) for t in texts], "t string")
    assert got == [plain(t) for t in texts]


def test_bert_normaliser(one):
    rows = [("Été\tÀ",), ("a中b",), ("x\u0000y\u200b",)]
    assert one(lambda d: T.normalize_text(C("t"), "bert"), rows, "t string") == ["ete a", "a 中 b", "xy"]


def test_normalisers_against_public_library(one):
    tokenizers = __import__("pytest").importorskip("tokenizers")
    n = tokenizers.normalizers
    texts = ["Héllo Wörld", "Ünï ``x''  y", "日本 text", "tab\there\r\nnew", "ＡＢＣ ﬁ"]
    bert = n.BertNormalizer(lowercase=True)
    got = one(lambda d: T.normalize_text(C("t"), "bert"), [(t,) for t in texts], "t string")
    assert got == [bert.normalize_str(t) for t in texts]
    seq = n.Sequence([n.Replace("``", '"'), n.Replace("''", '"'), n.NFKD(), n.StripAccents(),
                      n.Replace(tokenizers.Regex(" {2,}"), " ")])
    got = one(lambda d: T.normalize_text(C("t")), [(t,) for t in texts], "t string")
    assert got == [seq.normalize_str(t) for t in texts]


def test_arrays(one):
    rows = [([1, 2, 3],), ([],)]
    assert one(lambda d: keep_last(C("a"), 2), rows, "a array<int>") == [[2, 3], []]
    assert one(lambda d: keep_last(C("a"), 9), rows, "a array<int>") == [[1, 2, 3], []]
    assert one(lambda d: keep_first(C("a"), 2), rows, "a array<int>") == [[1, 2], []]
    pair = one(lambda d: xy_pair(C("a"), 2), rows[:1], "a array<int>")[0]
    assert (pair["x"], pair["y"]) == ([1, 2], [2, 3])
    nan, inf = float("nan"), float("inf")
    assert one(lambda d: finite(C("v")), [([1.0, nan, inf, -inf],)], "v array<double>") == [[1.0, 0.0, 0.0, 0.0]]
    assert one(lambda d: l2_normalize(C("v")), [([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>") == [[0.6, 0.8], [0.0, 0.0]]
    assert one(lambda d: cosine(C("a"), C("b")), [([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [2.0, 2.0])],
               "a array<double>, b array<double>")[0] == 0.0
