"""Small labelled statements for the model tests."""

WORDS = ["food order", "bus ticket", "movie night", "fuel refill", "rent bill", "gym pass", "book",
         "tax"]


def statement(spark, classes, copies=12):
    rows = [(i * classes + c, WORDS[c] + f" {i}", None if i == 1 else float(-50 + 40 * c + i),
             None if i == 2 else f"class{c}") for i in range(copies) for c in range(classes)]
    return spark.createDataFrame(rows, "txn_id long, description string, amount double, category string")
