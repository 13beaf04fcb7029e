"""Word lists and lookup tables that results depend on."""

from __future__ import annotations

# Substrings of a column name that call for a mean.
MEAN_WORDS = (
    "price rate cost fee wage salary avg average mean per_ _per ratio pct percent discount "
    "score index rank grade bmi temperature temp lat lon longitude latitude unitprice listprice "
    "unitcost level pollution stress access quality consumption cholesterol glucose pressure "
    "density concentration ph humidity speed velocity acceleration frequency probability "
    "confidence accuracy precision recall incidence prevalence mortality morbidity coefficient "
    "factor multiplier weight height depth width length age dosage dose reading measurement "
    "inflation gdp_per income_per unemployment poverty aqi pm2 co2 rainfall"
).split()

# Substrings that call for a sum.
SUM_WORDS = (
    "total revenue sales amount quantity qty volume sum subtotal income profit loss spend budget "
    "expense turnover gross net count transactions orders units visits clicks views receipts "
    "payments deposits withdrawals"
).split()

# Year, identifier and date words.
YEAR_WORDS = "year yr jahr anno année".split()
ID_WORDS = "_id id_ uuid guid hash code key ref sku number no. num #".split()
DATE_WORDS = "date time created updated modified timestamp start end born closed opened at on".split()

# Indicator (KPI) priority, first group that matches wins.
KPI_WORDS = (
    "incidence attack outcome target label event death mortality".split(),
    "revenue total amount income profit sales".split(),
    "price cost fee".split(),
    "rate index level score".split(),
)

# Words that mark a target column.
BINARY_TARGET_WORDS = "incidence attack outcome death event default churn fraud".split()
MEASURE_TARGET_WORDS = "rate incidence mortality risk".split()

# Money and percent words of indicator formatting.
MONEY_FORMAT_WORDS = "price cost revenue amount total subtotal".split()
PERCENT_FORMAT_WORDS = "pct percent discount rate".split()

# Lower-case country name -> ISO 3166 alpha-3.
COUNTRY_ISO3 = {
    "afghanistan": "AFG", "albania": "ALB", "algeria": "DZA", "angola": "AGO",
    "argentina": "ARG", "australia": "AUS", "austria": "AUT", "bangladesh": "BGD",
    "belgium": "BEL", "brazil": "BRA", "canada": "CAN", "chile": "CHL", "china": "CHN",
    "colombia": "COL", "denmark": "DNK", "egypt": "EGY", "ethiopia": "ETH", "finland": "FIN",
    "france": "FRA", "germany": "DEU", "ghana": "GHA", "greece": "GRC", "hungary": "HUN",
    "india": "IND", "indonesia": "IDN", "iran": "IRN", "iraq": "IRQ", "ireland": "IRL",
    "israel": "ISR", "italy": "ITA", "japan": "JPN", "jordan": "JOR", "kenya": "KEN",
    "south korea": "KOR", "korea": "KOR", "malaysia": "MYS", "mexico": "MEX", "morocco": "MAR",
    "netherlands": "NLD", "nigeria": "NGA", "norway": "NOR", "pakistan": "PAK", "peru": "PER",
    "philippines": "PHL", "poland": "POL", "portugal": "PRT", "qatar": "QAT", "romania": "ROU",
    "russia": "RUS", "saudi arabia": "SAU", "singapore": "SGP", "south africa": "ZAF",
    "spain": "ESP", "sweden": "SWE", "switzerland": "CHE", "thailand": "THA", "turkey": "TUR",
    "ukraine": "UKR", "uae": "ARE", "united kingdom": "GBR", "uk": "GBR",
    "united states": "USA", "usa": "USA", "us": "USA", "vietnam": "VNM", "zimbabwe": "ZWE",
}

# Resource types by URL fragment, tested in this order; default "Web".
RESOURCE_TYPES = (
    ("Video", ".mp4 .avi .mov .mkv .webm video youtube.com vimeo.com".split()),
    ("Image", ".png .jpg .jpeg .gif .webp flickr.com unsplash.com openimages image-dataset".split()),
    ("PDF", ".pdf filetype:pdf /pdf/ /report/ /publication/".split()),
    ("Excel", ".xlsx .xls format=xlsx".split()),
    ("JSON", ".json format=json .geojson /api/".split()),
    ("TSV", ".tsv filetype:tsv".split()),
    ("Parquet", ".parquet filetype:parquet".split()),
    ("CSV", ".csv format=csv download=csv".split()),
    ("CSV", (
        "kaggle.com data.gov worldbank ourworldindata oecd eurostat data.un archive.ics.uci "
        "fao.org nasa.gov fred.stlouisfed data.cdc data.europa data.gov.uk huggingface.co "
        "figshare zenodo opendata opendatasoft"
    ).split()),
    ("Excel", "statista imf.org".split()),
)

# Weight of a resource type in the relevance score.
TYPE_WEIGHTS = {
    "CSV": 6, "Excel": 5, "JSON": 4, "PDF": 3, "Video": 4, "Image": 4, "TSV": 3, "Parquet": 4,
    "Web": 1,
}

# Trusted data domains and title hint words.
TRUSTED_DOMAINS = (
    "kaggle.com data.gov worldbank.org ourworldindata.org github.com zenodo.org "
    "dataverse.harvard.edu data.europa.eu who.int data.un.org oecd.org eurostat imf.org "
    "statista.com opendatasoft.com registry.opendata.aws archive.ics.uci.edu "
    "fred.stlouisfed.org data.cdc.gov fao.org nasa.gov noaa.gov data.gov.uk huggingface.co "
    "figshare.com osf.io pangaea.de"
).split()
TITLE_HINTS = "dataset data statistics csv download indicator open".split()

# Routing keywords. A domain listed earlier wins a tie; a keyword given twice counts twice.
DOMAIN_KEYWORDS = {
    "powerbi": [
        "dashboard", "kpi", "report", "scorecard", "looker", "power bi", "tableau", "visualization", "visual", "metric",
        "drill", "slicer", "filter", "treemap", "funnel", "gauge", "pivot",
    ],
    "structural": [
        "beam", "deflect", "shear", "moment", "column", "buckling", "truss", "foundation", "bearing capacity", "steel",
        "concrete", "sap2000", "staad", "autocad", "dxf", "rebar", "footing", "rcc", "weld", "terzaghi", "euler",
    ],
    "chemical": [
        "distillation", "mccabe", "thiele", "heat exchanger", "lmtd", "reactor", "cstr", "pfr", "chemcad", "aspen",
        "hysys", "molar", "enthalpy", "entropy", "vapor", "liquid", "chemical", "boiling", "condensation", "pvt",
        "molecular", "formula", "chempy",
    ],
    "statistics": [
        "regression", "anova", "t-test", "p-value", "chi-square", "shapiro", "normality", "confidence interval",
        "hypothesis", "pearson", "spearman", "mann-whitney", "kruskal", "wilcoxon", "binomial", "poisson", "spss",
        "sas", "stata", "minitab", "jmp",
    ],
    "ml": [
        "machine learning", "neural network", "random forest", "decision tree", "svm", "knn", "gradient boost",
        "xgboost", "deep learning", "cluster", "pca", "dimensionality", "automl", "feature importance", "train test",
        "cross validation", "sklearn",
    ],
    "financial": [
        "npv", "irr", "dcf", "cash flow", "wacc", "option", "black-scholes", "portfolio", "sharpe", "markowitz",
        "bond", "yield", "dividend", "bloomberg", "roi", "payback", "amortization", "depreciation", "capex", "beta",
        "var", "stock", "equity", "ticker",
    ],
    "signal": [
        "fft", "fourier", "frequency spectrum", "bode", "transfer function", "pid", "control system", "butterworth",
        "filter", "matlab", "simulink", "labview", "step response", "pole", "zero", "nyquist", "laplace", "dsp", "pwm",
    ],
    "symbolic": [
        "derivative", "integral", "differential equation", "ode", "pde", "eigenvalue", "determinant",
        "laplace transform", "taylor series", "mathematica", "maple", "wolfram", "calculus", "solve equation",
        "simplify", "factor", "expand", "limit",
    ],
    "biology": [
        "dna", "rna", "protein", "sequence", "nucleotide", "genome", "bioinformatics", "blast", "gc content", "pcr",
        "codon", "transcription", "translation", "biopython", "dose response", "ic50", "ec50", "pharmacokinetics",
        "roc auc", "survival",
    ],
    "physics": [
        "projectile", "velocity", "acceleration", "gravity", "newton", "quantum", "wave", "optics", "lens", "snell",
        "electromagnetic", "thermodynamics", "carnot", "entropy", "schrodinger", "photon", "particle in a box",
    ],
    "fluid": [
        "pipe flow", "reynolds", "darcy", "moody", "friction factor", "bernoulli", "flow rate", "viscosity",
        "turbulent", "laminar", "pump", "pressure drop", "head loss", "hydraulics",
    ],
    "electrical": [
        "circuit", "resistor", "capacitor", "inductor", "rlc", "impedance", "resonance", "power factor", "3-phase",
        "transformer", "voltage", "current", "ohm", "kirchhoff", "thevenin", "pspice", "ltspice", "ac circuit",
        "dc circuit",
    ],
    "geospatial": [
        "map", "gis", "geographic", "latitude", "longitude", "arcgis", "qgis", "shapefile", "country map",
        "choropleth", "spatial",
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
        "time series", "arima", "autocorrelation", "acf", "pacf", "stationarity", "adf", "unit root", "granger",
        "panel data", "fixed effects", "eviews", "garch", "var model", "forecast arima",
    ],
    "environmental": [
        "carbon footprint", "co2 emission", "greenhouse gas", "water quality", "bod", "dissolved oxygen",
        "wastewater treatment", "hydrology", "watershed",
    ],
    "code": [
        "```python", "```r\n", "```c++", "```sql", "```julia", "```bash", "run python", "execute code",
        "python script", "r script", "compile c++",
    ],
}

# Emission factors (kg CO2 per unit) and tonnes one tree binds per year.
EMISSION_FACTORS = {"electricity": 0.4, "fuel": 2.31}
TREE_TONNES = 0.022

# Wording of question suggestions.
SUGGESTION_WORDS = {
    "en": {
        "top": "Top 10", "by": "by", "trend": "trend over", "dist": "Distribution of", "vs": "vs",
        "corr": "Correlation", "six": "Six Sigma", "reg": "Regression", "dash": "Build dashboard",
    },
    "de": {
        "top": "Top 10", "by": "nach", "trend": "Trend", "dist": "Verteilung", "vs": "vs",
        "corr": "Korrelation", "six": "Sechs Sigma", "reg": "Regression",
        "dash": "Dashboard erstellen",
    },
    "ur": {
        "top": "ٹاپ 10", "by": "کے", "trend": "ٹرینڈ", "dist": "تقسیم", "vs": "بمقابلہ",
        "corr": "ارتباط", "six": "سکس سگما", "reg": "ریگریشن", "dash": "ڈیش بورڈ",
    },
}

# The standard genetic code with the residue names shown, in TCAG order.
CODONS = {
    "TTT": "Phe", "TTC": "Phe", "TTA": "Leu", "TTG": "Leu",
    "TCT": "Ser", "TCC": "Ser", "TCA": "Ser", "TCG": "Ser",
    "TAT": "Tyr", "TAC": "Tyr", "TAA": "Stop", "TAG": "Stop",
    "TGT": "Cys", "TGC": "Cys", "TGA": "Stop", "TGG": "Trp",
    "CTT": "Leu", "CTC": "Leu", "CTA": "Leu", "CTG": "Leu",
    "CCT": "Pro", "CCC": "Pro", "CCA": "Pro", "CCG": "Pro",
    "CAT": "His", "CAC": "His", "CAA": "Gln", "CAG": "Gln",
    "CGT": "Arg", "CGC": "Arg", "CGA": "Arg", "CGG": "Arg",
    "ATT": "Ile", "ATC": "Ile", "ATA": "Ile", "ATG": "Met(Start)",
    "ACT": "Thr", "ACC": "Thr", "ACA": "Thr", "ACG": "Thr",
    "AAT": "Asn", "AAC": "Asn", "AAA": "Lys", "AAG": "Lys",
    "AGT": "Ser", "AGC": "Ser", "AGA": "Arg", "AGG": "Arg",
    "GTT": "Val", "GTC": "Val", "GTA": "Val", "GTG": "Val",
    "GCT": "Ala", "GCC": "Ala", "GCA": "Ala", "GCG": "Ala",
    "GAT": "Asp", "GAC": "Asp", "GAA": "Glu", "GAG": "Glu",
    "GGT": "Gly", "GGC": "Gly", "GGA": "Gly", "GGG": "Gly",
}


def has_word(name: str, words) -> bool:
    """Does the lower-cased column name contain any of the words?"""
    lowered = name.lower().replace(" ", "_")
    return any(w in lowered for w in words)
