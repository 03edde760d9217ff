"""Documents are parsed once, whatever is asked of them afterwards."""

from pyspark.sql import functions as F

from plumbline.operators.resources import resources_raw
from plumbline.sources.artifacts import manifests, parse_documents

TEXTS = ['{"nodes":{"a":{"resource_type":"model"},"b":1}}', "{}", "[{}]", "{},{}", "{}}", "{}],[{}", "null", "", None, '{"_":true}']


def test_a_text_is_parsed_once_behind_joins_and_filters(spark):
    names = spark.createDataFrame([(i, f"n{i}") for i in range(len(TEXTS))], "id long, name string")
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "id long, body string").join(names, "id")
    texts = texts.select("name", F.concat("body", F.lit(" ")).alias("body"))
    found = resources_raw(manifests(parse_documents(texts, "name", "body")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 2  # as an element and as a member
    assert plan.lower().count("schemaofvariant") == 0  # whether a value is an object does not need its schema
    assert [r[0] for r in found.select("unique_id").collect()] == ["a"]


def test_only_texts_of_one_object_are_documents(spark):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "id long, body string")
    good = parse_documents(texts, "id", "body").where("problem is null").orderBy("key").select("key", F.to_json("doc")).collect()
    assert [tuple(r) for r in good] == [(0, TEXTS[0]), (1, "{}"), (9, TEXTS[9])]
