import pytest
from pyspark.sql import functions as F

from threadloom.functions import spans as S
from threadloom.functions import text as X
from threadloom.functions import values as N
from threadloom.functions.latex import sexp, to_sexp


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make("x").alias("y")).first()["y"]


def test_strip_html_orders(spark):
    assert one(spark, "<p>a &lt;b&gt;  c</p>", X.strip_html) == "a <b> c"
    assert one(spark, "<p>a &lt;b&gt;  c</p>", lambda c: X.strip_html(c, decode_first=True)) == "a c"
    assert one(spark, None, X.strip_html) is None
    assert one(spark, "&eacute;&amp;", lambda c: X.decode_all_entities(F.col(c))) == "é&"


def test_latex_fragments(spark):
    assert one(spark, "$$a$$ text $$b$$", X.latex_fragments) == ["a", "b", "text"]
    assert one(spark, "so $c$ and $c$ or $d$", X.latex_fragments) == ["c", "d"]
    assert one(spark, "", X.latex_fragments) == []


def test_tags(spark):
    assert one(spark, "|a|b|", X.tags) == ["a", "b"]
    assert one(spark, "<a><b-c>", X.tags) == ["a", "b-c"]
    assert one(spark, None, X.tags) == []


def test_emphasis_and_references(spark):
    body = r"\emph{ring} \textbf{group} \emph{x} \PMlinkname{shown}{Target} \begin{proof} done \end{proof} \begin{align}x\end{align}"
    assert one(spark, body, X.emphasis_terms) == ["group", "ring", "Target"]
    assert [tuple(r) for r in one(spark, body, X.cross_references)] == [("shown", "Target")]
    assert [tuple(r) for r in one(spark, body, X.environments)] == [("proof", "done")]


def test_discovered_term(spark):
    f = lambda c: X.discovered_term(c, ["the", "of", "a"], ["thing"])
    assert one(spark, r"the \textbf{Category} of functors of", f) == "category of functors"
    assert one(spark, "thing", f) is None
    assert one(spark, "the of", f) is None
    assert one(spark, "one two three four five", f) is None
    assert one(spark, "x group", f) is None


def test_wiki_and_context(spark):
    assert one(spark, "## Head\n[[a|shown]] [[b]] *em*", X.strip_wiki) == "Head\nshown b em"
    assert one(spark, "x" * 130 + "TERM" + "y" * 130, lambda c: X.context(c, F.lit(130), F.lit(134))) == "... " + "x" * 120 + "<<TERM>>" + "y" * 120 + " ..."


def test_performative(spark):
    assert one(spark, "However, I agree", lambda c: X.performative(c)["act"]) == "challenge"
    assert one(spark, "Is it?\nYes", lambda c: X.performative(c)["act"]) == "query"
    assert one(spark, "plain", X.performative) is None


def test_sets_and_json(spark):
    df = spark.createDataFrame([([], []), (["a"], []), ([], ["a"]), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    rows = df.select(N.jaccard("a", "b").alias("j"), N.jaccard("a", "b", 1.0).alias("k"), N.precision_recall("a", "b").alias("p")).collect()
    assert [(round(r.j, 3), round(r.k, 3), tuple(r.p)) for r in rows] == [(0, 1, (1, 1)), (0, 0, (0, 1)), (0, 0, (0, 0)), (0.333, 0.333, (0.5, 0.5))]
    assert one(spark, 'so {"a": {"b": 1}} end }', N.json_part) == '{"a": {"b": 1}}'
    assert one(spark, "no { end", N.json_part) is None
    assert one(spark, "[1, 2] and 7", N.number_list) == [1, 2]
    assert one(spark, "3 and 99 and 25", N.number_list) == [3, 25]
    assert one(spark, "[1]", lambda c: N.strict_object(c)["error"]) == "not_an_object"
    assert one(spark, "{", lambda c: N.strict_object(c)["error"]) == "parse_error"


# Formulas and their s-expressions (fixed values).
FORMULAS = [
    (r"\Gamma=(V,E,s,t)", "(= Γ (tuple V E s t))"), (r"s(X(e))=X(s(e))", "(= (s (X e)) (X (s e)))"), (r"e : v \to w", "(: e (→ v w))"), (r"\mathcal{C}", "𝒞"),
    (r"X \circ s = X \circ t", "(= (∘ X s) (∘ X t))"), (r"\mathsf{Path}(\Gamma) \to \mathcal{C}", "(→ (Path Γ) 𝒞)"), (r"U(-)", "(U □)"), (r"\bar\Gamma", "(bar Γ)"), (r"\frac{a}{b}", "(/ a b)"),
    (r"x_i^2", "(sup (sub x i) 2)"), (r"\gamma'", "(prime γ)"), ("", '""'), (r"a \leq b", "a"), ("a =", '"a ="'), (r"X(\gamma):=\mathrm{id}_{X(v)}", "(:= (X γ) (sub id (X v)))"),
]


@pytest.mark.parametrize("latex,want", FORMULAS)
def test_sexp(latex, want):
    assert sexp(latex) == want


def test_sexp_column(spark):
    rows = spark.createDataFrame([(x,) for x, _ in FORMULAS] + [(None,)], "x string").select(to_sexp("x").alias("y")).collect()
    assert [r.y for r in rows] == [y for _, y in FORMULAS] + [None]


def test_scopes(spark):
    text = r"Let $X$ be a space. Assume that $x>0$. Then $\sum_{i=1} i$ and $\forall y$." "\nDefinition: so"
    rows = list(S.scopes()(text))
    assert [(r[0], r[1]) for r in rows] == [*enumerate(["bind/let", "assume/explicit", "env/definition", "bind/summation", "quant/universal"])]
    assert rows[0][5] == len(text) and rows[0][6] == [("symbol", "X"), ("type", "a space")]
    df = S.span_rows(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string"), "t", S.scopes(), S.SCOPE, ["id"])
    assert {r.id for r in df.collect()} == {1} and df.count() == 5


def test_environments_nest():
    found = S.wiki_environments("+-- {: .num_defn}\na\n+-- {: .proof}\nb\n=--\n=--\n\\begin{lemma}\\label{x}c\\end{lemma}\n+-- {: .open}\n")
    assert [(e[0], e[2]) for e in found] == [("env/definition", None), ("env/proof", None), ("env/lemma", "x")]


def test_diagrams():
    rows = list(S.diagrams(r"\begin{tikzcd} A \ar[r, " + '"f"' + r"] & B \\ C \ar[u] \end{tikzcd}"))
    assert [r[5] for r in rows if r[1] == "object"] == ["A", "B", "C"]
    assert [(r[5], r[6], r[7]) for r in rows if r[1] == "arrow"] == [("f", 0, None), ("", 2, 0)]


def test_expressions():
    assert [r[0] for r in S.expressions("$a$ $$b$$ $a$ \\(c\\)")] == ["a", "b", "c"]
    assert [r[0] for r in S.math_fragments("$a$ $$b$$ \\[d\\]")] == ["b", "d", "a"]
    assert list(S.theorem_blocks(r"\begin{theorem}[Name]\label{t}Body\end{theorem}"))[0][:4] == ("theorem", "Name", "t", "Body")


def test_introductions_equations_and_arrays():
    found = {(r[0], r[1]) for r in S.introductions(r"\emph{monad} and a thing called the free group. \begin{definition}A ring is a set\end{definition}")}
    assert {("latex-emph", "monad"), ("called-as", "free group"), ("definition-block-subject", "A ring")} <= found
    ports = list(S.equation_ports("x = 3 units; y >= 0. QED"))
    assert [(p[0], p[1]) for p in ports] == [("input", "bind/let"), ("output", "bind/let"), ("input", "constrain/such-that"), ("output", "constrain/such-that"), ("output", "wire/consequential")]
    rows = list(S.diagrams(r"\begin{array}{ccc} A & \stackrel{f}{\to} & B \\ \downarrow & & \\ C & & \end{array}"))
    assert [r[5] for r in rows if r[1] == "object"] == ["A", "B", "C"] and [(r[5], r[8]) for r in rows if r[1] == "arrow"] == [("f", "right"), (None, "down")]
