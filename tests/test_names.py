import random

import pytest

from moveproof import rules
from moveproof.functions import names as nm
from moveproof.operators import shape

# --- fixed values: name -> snake, camel, Pascal, kebab, lower, UPPER ---
STYLED = {
    "Customer ID": ("customer_id", "customerId", "CustomerId", "customer-id", "customer id",
                    "CUSTOMER ID"),
    "CustomerID": ("customer_id", "customerId", "CustomerId", "customer-id", "customerid",
                   "CUSTOMERID"),
    "customerID": ("customer_id", "customerId", "CustomerId", "customer-id", "customerid",
                   "CUSTOMERID"),
    "CUSTOMER_ID": ("customer_id", "customerId", "CustomerId", "customer-id", "customer_id",
                    "CUSTOMER_ID"),
    "customer-id": ("customer_id", "customerId", "CustomerId", "customer-id", "customer-id",
                    "CUSTOMER-ID"),
    "Customer.Name": ("customer_name", "customerName", "CustomerName", "customer-name",
                      "customer.name", "CUSTOMER.NAME"),
    "Customer   Name": ("customer_name", "customerName", "CustomerName", "customer-name",
                        "customer   name", "CUSTOMER   NAME"),
    " Customer Name": ("_customer_name", "CustomerName", "CustomerName", "-customer-name",
                       " customer name", " CUSTOMER NAME"),
    "123Customer": ("123_customer", "123Customer", "123Customer", "123-customer", "123customer",
                    "123CUSTOMER"),
    "Customer___ID": ("customer___id", "customerId", "CustomerId", "customer---id",
                      "customer___id", "CUSTOMER___ID"),
    "": ("", "", "", "", "", ""),
}
ORDER = ("snake_case", "camelCase", "PascalCase", "kebab-case", "lowercase", "UPPERCASE")


@pytest.mark.parametrize("i, style", list(enumerate(ORDER)))
def test_styles(rows, i, style):
    assert rows(list(STYLED), lambda c: nm.styled(c, style)) == [v[i] for v in STYLED.values()]


def test_preserve_and_unknown_style(rows):
    assert rows(["Customer ID"], lambda c: nm.styled(c, "preserve")) == ["Customer ID"]
    with pytest.raises(ValueError):
        rows(["x"], lambda c: nm.styled(c, "Train-Case"))


def test_resolved_names(rows):
    names = ["123Customer", "  Customer Name  ", "Customer   Name", "Customer@ID", "Customer#ID",
             "Customer*Name", "___", "emailaddr", "Phone"]
    wanted = ["123_customer", "customer_name", "customer_name", "customer_id", "customer_id",
              "customer_name", None, "email", "phone"]
    assert rows(names, lambda c: nm.resolved(
        c, "snake_case", rules.CHARACTER_REPLACEMENTS, {"EmailAddr": "email", "Phone": "phone"})) == wanted


def test_suffixes():
    assert nm.suffixed(["customer_id"] * 3) == ["customer_id", "customer_id_2", "customer_id_3"]
    assert nm.suffixed(["a", "b"]) == ["a", "b"]
    assert nm.suffixed(["x", "x", "x_2"]) == ["x", "x_2", "x_2_2"]
    assert nm.suffixed(["x_2", "x", "x"]) == ["x_2", "x", "x_3"]
    with pytest.raises(nm.NameCollision):
        nm.suffixed(["same", "same"], "fail")
    with pytest.raises(ValueError):
        nm.suffixed([], "other")


def test_one_target_holds_most_rows(spark):
    """A hot target is numbered across pieces exactly as one sorted run would."""
    data = [("t", i, "hot" if i % 3 else f"n{i}") for i in range(1000)]
    names = spark.createDataFrame(data, "table string, ordinal long, target string")
    got = {r["ordinal"]: r["final_name"]
           for r in shape.resolve_collisions(names, chunk_width=64).collect()}
    seen, wanted = {}, {}
    for _, i, target in data:
        seen[target] = seen.get(target, 0) + 1
        wanted[i] = target if seen[target] == 1 else f"{target}_{seen[target]}"
    assert got == wanted


@pytest.mark.parametrize("targets, wanted", [
    (["x", "x", "x_2"], ["x", "x_3", "x_2"]), (["x_2", "x", "x"], ["x_2", "x", "x_3"]),
    (["x", "x", "x", "x_2", "x_3", "x_2"], ["x", "x_4", "x_5", "x_2", "x_3", "x_2_2"]),
    (["x"] * 4 + ["x_3"], ["x", "x_2", "x_4", "x_5", "x_3"]), (["x", "x", "x_02"], ["x", "x_2", "x_02"]),
])
def test_no_name_is_given_twice(spark, targets, wanted):
    names = spark.createDataFrame(
        [("t", i, x) for i, x in enumerate(targets)], "table string, ordinal long, target string")
    got = shape.resolve_collisions(names, chunk_width=2).orderBy("ordinal").collect()
    assert [r["final_name"] for r in got] == wanted
    assert [r["is_moved"] for r in got] == [
        w != n and w != f"{n}_{targets[:i + 1].count(n)}" for i, (n, w) in enumerate(zip(targets, wanted))]


def test_mapping_precedence(spark):
    df = spark.createDataFrame([(1,) * 5], "CustomerID int, firstname int, _Nation int, "
                                           "Drop_Me int, `Order Total` int")
    names = shape.mapped_names(
        df, manual={"CustomerID": "customer_id", "FirstName": "first_name"},
        dictionary={"nation": "country"}, ignore=["DROP_ME"], replacements=[(" ", "_")],
    )
    assert names == {"CustomerID": "customer_id", "firstname": "first_name", "_Nation": "country",
                     "Order Total": "order_total"}
    assert shape.map_columns(df, names).columns == list(names.values())


def test_mapping_collision_is_an_error(spark):
    df = spark.createDataFrame([(1, 2)], "`A ` int, a_ int")
    with pytest.raises(nm.NameCollision):
        shape.mapped_names(df)


def test_camel_split_needs_lower_off(rows):
    values = ["OrderTotal"]
    assert rows(values, lambda c: nm.normalized(c, split_camel=True)) == ["ordertotal"]
    assert rows(values, lambda c: nm.normalized(c, lower=False, split_camel=True)) == ["order_total"]


def test_table_mapping(rows):
    mapping = {"Customer Records": "customers", "Supplier Master": "suppliers"}
    values = ["Customer Records", " SUPPLIER MASTER ", "old supplier master 2", "Other_"]
    assert rows(values, lambda c: nm.table_target(c, mapping)) == [
        "customers", "suppliers", "suppliers", "other"]


def test_clean_header():
    assert nm.clean_header("﻿ id ") == "id"


def words_by_hand(name):
    """Word borders read off character by character, for random names."""
    out = []
    for i, ch in enumerate(name):
        if ch in "-." or ch.isspace():
            if not (i and (name[i - 1] in "-." or name[i - 1].isspace())):
                out.append("_")
            continue
        before, after = name[i - 1] if i else "", name[i + 1] if i + 1 < len(name) else ""
        upper, lower = "A" <= ch <= "Z", "a" <= after <= "z"
        if upper and ("a" <= before <= "z" or "0" <= before <= "9"
                      or ("A" <= before <= "Z" and lower)):
            out.append("_")
        out.append(ch)
    return "".join(out).lower()


def test_words_against_brute_force(rows):
    rng = random.Random(3)
    names = ["".join(rng.choice("aBc9XyZ_-. \u00a0") for _ in range(rng.randint(0, 9)))
             for _ in range(1500)]
    got = rows(names, lambda c: nm.styled(c, "snake_case"))
    wrong = [(n, g, words_by_hand(n)) for n, g in zip(names, got) if g != words_by_hand(n)]
    assert not wrong
