"""Published values of the small sample tables."""

import pytest

from quarrylens.operators.profiling import (
    describe,
    detect_roles,
    detect_schema,
    feature_ranking,
    insights,
    quality,
    semantic_types,
    structure,
    trust,
)
from quarrylens.operators.statistics import correlations, strong_pairs
from quarrylens.sources.text_table import text_to_table

# Published rows of the sample tables, and what is published about them.
ORDERS = """1,101,2,3,2025-01-01,2025-01-05,Delivered,9833 Mt. Dias Blv.,1226 Shoe St.,1,10,2025-01-01 12:34:56
2,102,3,3,2025-01-05,2025-01-10,Shipped,250 Race Court,N/A,1,15,2025-01-05 23:22:04
3,101,1,5,2025-01-10,2025-01-25,Delivered,8157 W. Book,8157 W. Book,2,20,2025-01-10 18:24:08
4,105,1,3,2025-01-20,2025-01-25,Shipped,5724 Victory Lane,N/A,2,60,2025-01-20 05:50:33
5,104,2,5,2025-02-01,2025-02-05,Delivered,N/A,N/A,1,25,2025-02-01 14:02:41
6,104,3,5,2025-02-05,2025-02-10,Delivered,1792 Belmont Rd.,N/A,2,50,2025-02-06 15:34:57
7,102,1,1,2025-02-15,2025-02-27,Delivered,136 Balboa Court,N/A,2,30,2025-02-16 06:22:01
9,101,2,3,2025-03-10,2025-03-15,Shipped,3768 Door Way,N/A,2,20,2025-03-10 12:59:04
10,102,3,5,2025-03-15,2025-03-20,Shipped,N/A,N/A,0,60,2025-03-16 23:25:15"""
ORDER_SCHEMA = (
    "OrderID long, ProductID long, CustomerID long, SalesPersonID long, OrderDate string, ShipDate string, "
    "OrderStatus string, ShipAddress string, BillAddress string, Quantity long, Sales long, CreationTime string"
)
NUMBERS = ["OrderID", "ProductID", "CustomerID", "SalesPersonID", "Quantity", "Sales"]


@pytest.fixture(scope="module")
def orders(spark):
    rows = []
    for line in ORDERS.splitlines():
        p = line.split(",")
        rows.append((*map(int, p[:4]), *p[4:9], int(p[9]), int(p[10]), p[11]))
    return spark.createDataFrame(rows, ORDER_SCHEMA)


@pytest.fixture(scope="module")
def employees(spark):
    rows = [
        (1, "Frank", "Lee", "Marketing", "1988-12-05", "M", 55000, 1.5),
        (2, "Kevin", "Brown", "Marketing", "1972-11-25", "M", 65000, 1.0),
        (3, "Mary", "N/A", "Sales", "1986-01-05", "F", 75000, 1.0),
        (4, "Michael", "Ray", "Sales", "1977-02-10", "M", 90000, 2.0),
    ]
    return spark.createDataFrame(
        rows,
        "EmployeeID long, FirstName string, LastName string, Department string, BirthDate string, "
        "Gender string, Salary long, ManagerID double",
    )


# column: mean, median, std, skewness, variance, unique ratio
ORDER_VALUES = {
    "OrderID": (5.2222, 5.0, 3.0732, 0.2632, 9.4444, 1.0),
    "ProductID": (102.4444, 102.0, 1.5092, 0.6972, 2.2778, 0.4444),
    "CustomerID": (2.0, 2.0, 0.8660, 0.0, 0.75, 0.3333),
    "SalesPersonID": (3.6667, 3.0, 1.4142, -0.6061, 2.0, 0.3333),
    "Quantity": (1.4444, 2.0, 0.7265, -1.0143, 0.5278, 0.3333),
    "Sales": (32.2222, 25.0, 19.3828, 0.6260, 375.6944, 0.7778),
}
EMPLOYEE_VALUES = {
    "Salary": (71250.0, 70000.0, 14930.3941, 0.4225, 222916666.6667, 1.0),
    "ManagerID": (1.375, 1.25, 0.4787, 0.8546, 0.2292, 0.75),
}


@pytest.mark.parametrize("table,values", [("orders", ORDER_VALUES), ("employees", EMPLOYEE_VALUES)])
def test_schema_and_quality(request, table, values):
    df = request.getfixturevalue(table)
    schema = {r["column"]: r for r in detect_schema(df).collect()}
    shares = {r["column"]: r for r in quality(df).collect()}
    for column, (mean, median, std, skew, variance, unique) in values.items():
        s, q = schema[column], shares[column]
        assert (s["mean"], s["median"], s["std"]) == pytest.approx((mean, median, std), abs=1e-4)
        assert (q["skewness"], q["variance"], q["unique_ratio"]) == pytest.approx((skew, variance, unique), abs=1e-4)


def test_roles(orders):
    roles = {r["column"]: r["role"] for r in detect_roles(orders).collect()}
    keys = {"OrderID", "CreationTime", "OrderDate"}
    assert {c for c, r in roles.items() if r == "Primary Key"} == keys
    assert {r for c, r in roles.items() if c not in keys} == {"Potential Foreign Key"}


def test_semantic_types(orders, employees):
    types = {r["column"]: r["semantic_type"] for df in (orders, employees) for r in semantic_types(df).collect()}
    assert types["OrderID"] == types["ManagerID"] == "identifier"
    assert types["OrderDate"] == types["CreationTime"] == types["BirthDate"] == "datetime"
    assert types["Quantity"] == types["Sales"] == types["Salary"] == "numeric_metric"
    assert types["OrderStatus"] == types["ShipAddress"] == types["Gender"] == "categorical_or_text"


def test_insights(orders, employees):
    low = {r["column"] for r in insights(orders).collect() if r["insight"] == "low_variability"}
    assert low == {"ProductID", "CustomerID", "SalesPersonID", "Quantity"}
    found = [(r["column"], r["insight"]) for r in insights(employees).collect()]
    assert ("ManagerID", "duplicate_identifier") in found and ("EmployeeID", "duplicate_identifier") not in found


def test_outcome(orders):
    assert [r["column"] for r in structure(orders).collect() if r["is_outcome"]] == ["Sales"]


def test_trust_of_clean_table(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(20)], "a long, b double")
    row = trust(df).first()
    assert row["overall_score"] == row["null_score"] == row["relationship_score"] == 100.0


def test_feature_ranking(orders):
    got = [(r["column"], round(r["score"], 3)) for r in feature_ranking(orders).collect()]
    assert got == [
        ("Sales", 292.207), ("OrderID", 9.444), ("ProductID", 1.012), ("SalesPersonID", 0.667),
        ("CustomerID", 0.25), ("Quantity", 0.176),
    ]


def test_correlations(spark, employees):
    r = {m: correlations(employees, ["EmployeeID", "Salary"], m).first()["r"] for m in ("pearson", "spearman")}
    assert round(r["pearson"], 3) == 0.994 and r["spearman"] == pytest.approx(1.0)
    customers = spark.createDataFrame([(2, 900.0), (3, 750.0), (4, 500.0), (5, 625.0)], "CustomerID long, Score double")
    r = {m: correlations(customers, ["CustomerID", "Score"], m).first()["r"] for m in ("pearson", "spearman")}
    assert round(r["pearson"], 2) == -0.81 and r["spearman"] == pytest.approx(-0.8)
    products = spark.createDataFrame([(102, 15), (103, 20), (104, 25), (105, 30)], "ProductID long, Price long")
    assert "redundant" in {x["kind"] for x in strong_pairs(products, ["ProductID", "Price"]).collect()}


def test_two_rows_have_no_skew(spark):
    lines = ["OrderID: 1001 | Customer: John | Amount: 450", "OrderID: 1002 | Customer: Anna | Amount: 300"]
    df = text_to_table(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "string", "bigint"]
    stats = {r["column"]: r for r in describe(df, ["OrderID", "Amount"]).collect()}
    assert stats["Amount"]["mean"] == 375.0 and stats["Amount"]["skewness"] is None
    assert stats["OrderID"]["median"] == 1001.5
    types = {r["column"]: r["semantic_type"] for r in semantic_types(df).collect()}
    assert types == {"OrderID": "identifier", "Customer": "categorical_or_text", "Amount": "monetary"}
