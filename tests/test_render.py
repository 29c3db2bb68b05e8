from decimal import Decimal

import pytest

from marginalia.plans.render import dependencies, render
from marginalia.spec import DocumentSpec, EntityCatalog, InvalidRelationPath, Relation


def fixture(spark):
    c = EntityCatalog()
    c.register("category", spark.createDataFrame([(1, "Electronics"), (2, None)], "id bigint, name string"))
    c.register("brand", spark.createDataFrame([(5, "Acme", 1)], "id bigint, name string, category_id bigint"), relations={"category": Relation("one", "category", local="category_id")})
    c.register("feature", spark.createDataFrame([(1, "Waterproof"), (2, "Bluetooth"), (3, None)], "id bigint, name string"))
    bridge = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (2, 3, 1), (2, 3, 2), (3, None, 1), (None, 1, 1)], "product_id bigint, feature_id bigint, place int")
    rows = [(1, "Speaker", "SPK-001", Decimal("49.99"), 1, 5), (2, None, "X", None, 2, None), (3, "Lost", "Y", Decimal("1"), 99, 99), (None, "no key", "Z", None, 1, 5)]
    relations = {
        "category": Relation("one", "category", local="category_id"),
        "brand": Relation("one", "brand", local="brand_id"),
        "features": Relation("bridge", "feature", local="product_id", foreign="feature_id", bridge=bridge, order_by=("place",)),
    }
    spec = DocumentSpec(("name", "sku", "price"), ("category.name", "brand.name", "features.name"))
    # Columns called like internal ones must not matter.
    products = spark.createDataFrame(rows, "id bigint, name string, sku string, price decimal(10,2), category_id bigint, brand_id bigint").selectExpr("*", "'k' AS k", "'v' AS v", "'t' AS t", "'x' AS text", "'y' AS entity_id")
    c.register("product", products, relations=relations, spec=spec)
    c.register("shelf", spark.createDataFrame([(1,), (2,)], "id bigint"), relations={"products": Relation("many", "product", foreign="category_id", order_by=("sku",))})
    return c


def docs(df):
    return {r.entity_id: r.text for r in df.collect()}


def test_golden_document(spark):
    got = docs(render(fixture(spark), "product"))
    assert got[1] == "name: Speaker\nsku: SPK-001\nprice: 49.99\ncategory.name: Electronics\nbrand.name: Acme\nfeatures.name: Bluetooth, Waterproof"
    assert got[2] == "name: \nsku: X\nprice: \ncategory.name: \nbrand.name: \nfeatures.name: , "
    assert got[3] == "name: Lost\nsku: Y\nprice: 1.00\ncategory.name: \nbrand.name: \nfeatures.name: "
    assert set(got) == {1, 2, 3}


def test_kept_order_and_lists_of_relations(spark):
    c = fixture(spark)
    assert docs(render(c, "product", DocumentSpec((), ("features.name",), ("features.name",))))[1] == "features.name: Bluetooth, Waterproof"
    assert docs(render(c, "product", DocumentSpec((), ("features.id",), ("features.id",))))[1] == "features.id: 2, 1"
    shelf = DocumentSpec((), ("products.name", "products.features.name", "products.brand.category.name"))
    assert docs(render(c, "shelf", shelf))[1] == "products.name: Speaker\nproducts.features.name: Bluetooth, Waterproof\nproducts.brand.category.name: Electronics"
    assert docs(render(c, "product", DocumentSpec((), ("brand.category.name",))))[1] == "brand.category.name: Electronics"


def test_paths_are_validated(spark):
    c = fixture(spark)
    for path, word in (("categroy.name", "no relation"), ("name.x", "not a relation"), ("category", "names no relation"), ("category.name.x", "not a relation")):
        with pytest.raises(InvalidRelationPath, match=word):
            render(c, "product", DocumentSpec((), (path,)))
    assert docs(render(c, "product", DocumentSpec(("nothing",), ("category.nothing",))))[1] == "nothing: \ncategory.nothing: "
    with pytest.raises(ValueError):
        render(c, "product", DocumentSpec(("nothing",)), strict=True)
    with pytest.raises(ValueError):
        render(c, "product", DocumentSpec((), ("category.nothing",)), strict=True)
    with pytest.raises(ValueError):
        Relation("one", "x")


def test_spec_is_built_fluently():
    s = DocumentSpec().with_content("a").with_content("b", "c").relation("x.y").relation("z.y").keep_order("x.y").keep_order("z.y")
    assert (s.content, s.relations, s.ordered) == (("b", "c"), ("x.y", "z.y"), ("x.y", "z.y"))


def test_dependencies(spark):
    c = fixture(spark)
    got = {tuple(r) for r in dependencies(c, "product").collect()}
    assert got == {(1, "category", 1), (2, "category", 2), (1, "brand", 5), (1, "feature", 1), (1, "feature", 2), (2, "feature", 3)}
    far = DocumentSpec((), ("brand.category.name",))
    assert {tuple(r) for r in dependencies(c, "product", far).collect()} == {(1, "category", 1)}
    assert {tuple(r) for r in dependencies(c, "product", far, track_intermediate=True).collect()} == {(1, "category", 1), (1, "brand", 5)}
    assert dependencies(c, "product", DocumentSpec(("name",))).count() == 0


def test_empty_tables(spark):
    c = fixture(spark)
    c.register("none", c["product"].rows.limit(0), relations=c["product"].relations, spec=c["product"].spec)
    assert render(c, "none").count() == 0 and dependencies(c, "none").count() == 0
