from pyspark.sql import functions as F

from quirestone.operators.embed import mock_embedding
from quirestone.plans import pipelines

POINTS = "point_id string, chunk_id string, document_id string, section_path array<string>, chunk_index int, original_text string, content_hash string, embedding_text string"


def test_later_candidates_take_the_places_of_duplicates_and_neighbours(spark):
    asked = spark.createDataFrame([(1, "What is the supply voltage?")], "query_id long, question string")
    word = lambda i: "same" if i < 3 else f"text {i}"
    # copies first, then two neighbours, then candidates beyond the first five
    places = [("d0", 0), ("d1", 0), ("d2", 0), ("n", 4), ("n", 5), ("d5", 0), ("d6", 0), ("d7", 0), ("d8", 0)]
    rows = [(f"{i}", f"k{i}", d, ["A"], at, word(i), word(i), word(i)) for i, (d, at) in enumerate(places)]
    points = spark.createDataFrame(rows, POINTS)
    vector = mock_embedding(F.lit("What is the supply voltage?"), pipelines.DIMENSIONS)
    # the cosine falls with the point's number
    bent = F.transform(vector, lambda x, i: F.when(i == 0, x + F.col("point_id").cast("int") * 0.05).otherwise(x))
    [r] = pipelines.ask(asked, points.withColumn("vector", bent)).collect()
    block = r.context_block
    assert [t for t in ("same", "text 3", "text 4", "text 5", "text 6", "text 7", "text 8") if t in block] == ["same", "text 3", "text 4", "text 5", "text 6", "text 7"]
    assert block.count("same") == 1 and [f"[c{i}]" in block for i in range(1, 7)] == [True] * 5 + [False]
