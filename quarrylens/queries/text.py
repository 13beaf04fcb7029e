"""Catalogue, routing, sequences, emissions and run history over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import catalog
from quarrylens.queries.loading import fresh_path
from quarrylens.queries.registry import query


# The lists that the SQL looks for, written here on their own.
TYPES = (
    ("Video", """
        .mp4 .avi .mov .mkv .webm video youtube.com vimeo.com
    """),
    ("Image", """
        .png .jpg .jpeg .gif .webp flickr.com unsplash.com openimages image-dataset
    """),
    ("PDF", """
        .pdf filetype:pdf /pdf/ /report/ /publication/
    """),
    ("Excel", """
        .xlsx .xls format=xlsx
    """),
    ("JSON", """
        .json format=json .geojson /api/
    """),
    ("TSV", """
        .tsv filetype:tsv
    """),
    ("Parquet", """
        .parquet filetype:parquet
    """),
    ("CSV", """
        .csv format=csv download=csv
    """),
    ("CSV", """
        kaggle.com data.gov worldbank ourworldindata oecd eurostat data.un archive.ics.uci fao.org nasa.gov
        fred.stlouisfed data.cdc data.europa data.gov.uk huggingface.co figshare zenodo opendata opendatasoft
    """),
    ("Excel", """
        statista imf.org
    """),
)
WEIGHTS = {"CSV": 6, "Excel": 5, "JSON": 4, "PDF": 3, "Video": 4, "Image": 4, "TSV": 3, "Parquet": 4, "Web": 1}
TRUSTED = """
    kaggle.com data.gov worldbank.org ourworldindata.org github.com zenodo.org dataverse.harvard.edu
    data.europa.eu who.int data.un.org oecd.org eurostat imf.org statista.com opendatasoft.com
    registry.opendata.aws archive.ics.uci.edu fred.stlouisfed.org data.cdc.gov fao.org nasa.gov noaa.gov
    data.gov.uk huggingface.co figshare.com osf.io pangaea.de
""".split()
HINTS = "dataset data statistics csv download indicator open".split()
DOMAINS = {
    "powerbi": [
        "dashboard", "kpi", "report", "scorecard", "looker", "power bi", "tableau", "visualization", "visual", "metric",
        "drill", "slicer", "filter", "treemap", "funnel", "gauge", "pivot",
    ],
    "structural": [
        "beam", "deflect", "shear", "moment", "column", "buckling", "truss", "foundation", "bearing capacity", "steel",
        "concrete", "sap2000", "staad", "autocad", "dxf", "rebar", "footing", "rcc", "weld", "terzaghi", "euler",
    ],
    "chemical": [
        "distillation", "mccabe", "thiele", "heat exchanger", "lmtd", "reactor", "cstr", "pfr", "chemcad", "aspen", "hysys",
        "molar", "enthalpy", "entropy", "vapor", "liquid", "chemical", "boiling", "condensation", "pvt", "molecular",
        "formula", "chempy",
    ],
    "statistics": [
        "regression", "anova", "t-test", "p-value", "chi-square", "shapiro", "normality", "confidence interval", "hypothesis",
        "pearson", "spearman", "mann-whitney", "kruskal", "wilcoxon", "binomial", "poisson", "spss", "sas", "stata", "minitab",
        "jmp",
    ],
    "ml": [
        "machine learning", "neural network", "random forest", "decision tree", "svm", "knn", "gradient boost", "xgboost",
        "deep learning", "cluster", "pca", "dimensionality", "automl", "feature importance", "train test", "cross validation",
        "sklearn",
    ],
    "financial": [
        "npv", "irr", "dcf", "cash flow", "wacc", "option", "black-scholes", "portfolio", "sharpe", "markowitz", "bond",
        "yield", "dividend", "bloomberg", "roi", "payback", "amortization", "depreciation", "capex", "beta", "var", "stock",
        "equity", "ticker",
    ],
    "signal": [
        "fft", "fourier", "frequency spectrum", "bode", "transfer function", "pid", "control system", "butterworth", "filter",
        "matlab", "simulink", "labview", "step response", "pole", "zero", "nyquist", "laplace", "dsp", "pwm",
    ],
    "symbolic": [
        "derivative", "integral", "differential equation", "ode", "pde", "eigenvalue", "determinant", "laplace transform",
        "taylor series", "mathematica", "maple", "wolfram", "calculus", "solve equation", "simplify", "factor", "expand",
        "limit",
    ],
    "biology": [
        "dna", "rna", "protein", "sequence", "nucleotide", "genome", "bioinformatics", "blast", "gc content", "pcr", "codon",
        "transcription", "translation", "biopython", "dose response", "ic50", "ec50", "pharmacokinetics", "roc auc",
        "survival",
    ],
    "physics": [
        "projectile", "velocity", "acceleration", "gravity", "newton", "quantum", "wave", "optics", "lens", "snell",
        "electromagnetic", "thermodynamics", "carnot", "entropy", "schrodinger", "photon", "particle in a box",
    ],
    "fluid": [
        "pipe flow", "reynolds", "darcy", "moody", "friction factor", "bernoulli", "flow rate", "viscosity", "turbulent",
        "laminar", "pump", "pressure drop", "head loss", "hydraulics",
    ],
    "electrical": [
        "circuit", "resistor", "capacitor", "inductor", "rlc", "impedance", "resonance", "power factor", "3-phase",
        "transformer", "voltage", "current", "ohm", "kirchhoff", "thevenin", "pspice", "ltspice", "ac circuit", "dc circuit",
    ],
    "geospatial": [
        "map", "gis", "geographic", "latitude", "longitude", "arcgis", "qgis", "shapefile", "country map", "choropleth",
        "spatial",
    ],
    "sql": [
        "select ", "from ", "where ", "group by", "having ", "join ", "union ", "cte", "window function", "duckdb",
        "sql query", "database",
    ],
    "manufacturing": [
        "six sigma", "cpk", "cpk", "dpmo", "control chart", "ucl", "lcl", "x-bar", "spc", "process capability",
        "minitab quality", "defect", "tolerance",
    ],
    "econometrics": [
        "time series", "arima", "autocorrelation", "acf", "pacf", "stationarity", "adf", "unit root", "granger", "panel data",
        "fixed effects", "eviews", "garch", "var model", "forecast arima",
    ],
    "environmental": [
        "carbon footprint", "co2 emission", "greenhouse gas", "water quality", "bod", "dissolved oxygen",
        "wastewater treatment", "hydrology", "watershed",
    ],
    "code": [
        "```python", "```r\n", "```c++", "```sql", "```julia", "```bash", "run python", "execute code", "python script",
        "r script", "compile c++",
    ],
}
CODE = {
    "Phe": "TTT TTC",
    "Leu": "TTA TTG CTT CTC CTA CTG",
    "Ser": "TCT TCC TCA TCG AGT AGC",
    "Tyr": "TAT TAC",
    "Stop": "TAA TAG TGA",
    "Cys": "TGT TGC",
    "Trp": "TGG",
    "Pro": "CCT CCC CCA CCG",
    "His": "CAT CAC",
    "Gln": "CAA CAG",
    "Arg": "CGT CGC CGA CGG AGA AGG",
    "Ile": "ATT ATC ATA",
    "Met(Start)": "ATG",
    "Thr": "ACT ACC ACA ACG",
    "Asn": "AAT AAC",
    "Lys": "AAA AAG",
    "Val": "GTT GTC GTA GTG",
    "Ala": "GCT GCC GCA GCG",
    "Asp": "GAT GAC",
    "Glu": "GAA GAG",
    "Gly": "GGT GGC GGA GGG",
}


def _has(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _hits(column: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({column}, '{w}') AS INTEGER)" for w in words) + ")"


TYPE_SQL = "CASE " + " ".join(f"WHEN {_has('lower(url)', w.split())} THEN '{n}'" for n, w in TYPES) + " ELSE 'Web' END"
# The pages of the test data are plain sites; give some of them data-file addresses.
PAGES = """
SELECT page_id, concat(url, CASE page_id % 6 WHEN 0 THEN '/data.csv' WHEN 1 THEN '/api/v1' WHEN 2 THEN '/zenodo/report.pdf'
       WHEN 3 THEN '/sheet.xlsx' ELSE '' END) AS url, html FROM {pages}
"""
PAGES_SQL = "p AS (" + PAGES.replace("{pages}", "pages") + ")"


def addressed(t):
    return t.sql(PAGES, "pages")


@query("g1_resource_type", f"WITH {PAGES_SQL} SELECT page_id, url, {TYPE_SQL} AS type FROM p")
def resource_type(t):
    return catalog.resource_type(addressed(t).drop("html"), "url")


WORDS = ("data", "report", "the", "that")
SCORE_SQL = f"""
x AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, {TYPE_SQL} AS type FROM p),
s AS (SELECT *, 2.0 * {_hits('lower(title)', WORDS)} + 0.5 * {_hits('lower(url)', WORDS)}
  + 0.8 * CASE type {" ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items())} END
  + CASE WHEN {_has('lower(url)', TRUSTED)} THEN 3.0 ELSE 0.0 END + 0.4 * {_hits('lower(title)', HINTS)} AS score FROM x)
"""


def titled(t):
    return addressed(t).select("page_id", "url", catalog.html_title("html").alias("title"))


@query("g2_relevance", f"WITH {PAGES_SQL}, {SCORE_SQL} SELECT page_id, type, CAST(score AS DOUBLE) AS score FROM s", approx="score")
def relevance(t):
    return catalog.relevance(titled(t), "title", "url", " ".join(WORDS)).select("page_id", "type", "score")


@query("g3_search", f"""
WITH {PAGES_SQL}, {SCORE_SQL}, f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1)
SELECT url, title, type, CAST(round(score, 6) AS DOUBLE) AS score FROM f ORDER BY round(score, 6) DESC, url LIMIT 20
""", approx="score")
def search(t):
    return catalog.search(titled(t), " ".join(WORDS), "title", "url", "page_id")


@query("g3_search_by_type", f"""
WITH {PAGES_SQL}, {SCORE_SQL}, f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1)
SELECT url, title, type, CAST(round(score, 6) AS DOUBLE) AS score FROM f WHERE type = 'CSV'
ORDER BY round(score, 6) DESC, url LIMIT 20 OFFSET 5
""", approx="score")
def search_by_type(t):
    return catalog.search(titled(t), " ".join(WORDS), "title", "url", "page_id", "CSV", offset=5)


def _route_sql(source: str, key: str) -> str:
    literal = lambda w: w.replace("'", "''")
    scores = ", ".join(
        f"2 * {_hits('x', [literal(w) for w in ws])} AS s{i}" for i, ws in enumerate(DOMAINS.values())
    )
    best = "greatest(" + ", ".join(f"s{i}" for i in range(len(DOMAINS))) + ")"
    pick = " ".join(f"WHEN s{i} = {best} THEN '{d}'" for i, d in enumerate(DOMAINS))
    return f"""
WITH v AS (SELECT {key}, {scores} FROM (SELECT {key}, lower(text) AS x FROM {source}))
SELECT {key}, CASE WHEN {best} = 0 THEN 'statistics' {pick} END AS domain, CAST({best} AS INTEGER) AS domain_score FROM v
"""


@query("g4_route_turns", _route_sql("conversations", "conv_id, turn"))
def route_turns(t):
    return catalog.route(t.conversations, "text").select("conv_id", "turn", "domain", "domain_score")


@query("g4_route_documents", _route_sql("documents", "doc_id"))
def route_documents(t):
    return catalog.route(t.documents, "text").select("doc_id", "domain", "domain_score")


BASES_SQL = "b AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents)"


def bases(t):
    return t.pick("documents", "doc_id", "text").select("doc_id", F.regexp_replace(F.upper("text"), "[^ACGT]+", "").alias("seq"))


def _count(b):
    return f"CAST(length(seq) - length(replace(seq, '{b}', '')) AS INTEGER)"


@query("g5_sequence_stats", f"""
WITH {BASES_SQL}, k AS (SELECT doc_id, seq, {_count('A')} AS a, {_count('T')} AS t, {_count('G')} AS g, {_count('C')} AS c FROM b)
SELECT doc_id, CAST(length(seq) AS INTEGER) AS length, a, t, g, c, (g + c) / greatest(length(seq), 1) * 100 AS gc_pct,
       CAST(2 * (a + t) + 4 * (g + c) AS INTEGER) AS tm, translate(seq, 'ATCG', 'TAGC') AS complement,
       reverse(translate(seq, 'ATCG', 'TAGC')) AS reverse_complement FROM k
""", approx="gc_pct")
def sequence_stats(t):
    return catalog.sequence_stats(bases(t), "seq").drop("seq")


@query("g5_codon_counts", f"""
WITH {BASES_SQL}, c AS (SELECT unnest(regexp_extract_all(seq, '...')) AS codon FROM b)
SELECT codon, count(*) AS count, CASE codon {" ".join(f"WHEN '{k}' THEN '{v}'" for v, codons in CODE.items() for k in codons.split())} ELSE '?' END AS residue
FROM c GROUP BY codon
""")
def codon_counts(t):
    return catalog.codon_counts(bases(t), "seq")


@query("g6_emissions", """
WITH a AS (SELECT p_type, CASE WHEN p_size % 2 = 0 THEN 'electricity' ELSE 'fuel' END AS source, sum(l_quantity) AS q
           FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
k AS (SELECT p_type, sum(q * CASE source WHEN 'electricity' THEN 0.4 ELSE 2.31 END) AS kg FROM a GROUP BY 1)
SELECT p_type, kg, kg / 1000 AS tonnes, kg / 1000 / 0.022 AS trees FROM k
""", approx="kg tonnes trees")
def emissions(t):
    part = t.part.select("p_partkey", "p_type", F.when(F.col("p_size") % 2 == 0, "electricity").otherwise("fuel").alias("source"))
    activity = t.lineitem.select("l_partkey", "l_quantity").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return catalog.emissions(activity, "p_type", "source", "l_quantity")


@query("g7_benchmark_compare", """
WITH run AS (SELECT o_orderpriority AS context, 'mean_price' AS metric, avg(o_totalprice) AS value FROM orders GROUP BY 1),
past AS (SELECT o_orderpriority AS context, 'mean_price' AS metric, avg(o_totalprice) AS value FROM orders GROUP BY o_orderpriority, o_orderstatus),
h AS (SELECT context, metric, count(*) AS past_runs, avg(value) AS past_mean FROM past GROUP BY 1, 2)
SELECT context, metric, value, past_runs, past_mean, round((value - past_mean) / abs(past_mean) * 100, 7) AS change_pct FROM run JOIN h USING (context, metric)
""", approx="value past_mean")
def benchmark_compare(t):
    path = fresh_path(t.spark, "history")
    metric = F.avg("o_totalprice").alias("value")
    label = [F.col("o_orderpriority").alias("context"), F.lit("mean_price").alias("metric"), "value"]
    past = t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(metric).select(*label)
    catalog.benchmark_store(past, path)
    run = t.orders.groupBy("o_orderpriority").agg(metric).select(*label)
    out = catalog.benchmark_compare(run, t.spark.read.parquet(path))
    return out.withColumn("change_pct", F.round("change_pct", 7) + F.lit(0.0))
