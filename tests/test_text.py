from pyspark.sql import functions as F

from lexiflow.functions import text as X


def one(spark, expr, value):
    df = spark.createDataFrame([(value,)], "s string")
    return df.select(expr(F.col("s")).alias("r")).first()["r"]


def test_null_and_empty_become_empty(spark):
    for f in (X.clean_punct, X.clean_light, X.clean_letters, X.clean_letters_normalized):
        assert one(spark, f, None) == ""
        assert one(spark, f, "") == ""
    assert one(spark, lambda c: X.clean_strict(c, [], X.ALPHABET_RU), None) == ""


def test_urls_and_mentions_removed_with_cyrillic(spark):
    assert one(spark, lambda c: X.clean_letters_normalized(c, X.ALPHABET_RU_LATIN), "@Иван http://x.y Привет мир") \
        == "привет мир"


def test_collapse_order_differs_between_variants(spark):
    # P05 collapses before the letter strip, so the removed '1' leaves two spaces
    assert one(spark, lambda c: X.clean_letters(c, X.ALPHABET_ANY), "a 1 b") == "a  b"
    assert one(spark, lambda c: X.clean_letters_normalized(c, X.ALPHABET_ANY), "a 1 b") == "a b"


def test_punctuation_kept(spark):
    assert one(spark, lambda c: X.clean_punct(c, X.ALPHABET_ANY), "Hi; there: yes!") == "hi; there: yes!"
    assert one(spark, lambda c: X.clean_light(c, X.ALPHABET_ANY), "Hi; there: yes!") == "hi there yes!"


def test_strict_drops_short_and_stopwords(spark):
    r = one(spark, lambda c: X.clean_strict(c, ["это"], X.ALPHABET_RU), "Это  очень хорошо, да!")
    assert r == "очень хорошо"


def test_tokenizers(spark):
    assert one(spark, X.tokenize_words, "Hello, wörld_1!  x") == ["hello", "wörld_1", "x"]
    assert one(spark, X.tokenize_space, "a  b") == ["a", "", "b"]
    assert one(spark, X.tokenize_whitespace, "  a \n b ") == ["a", "b"]
    assert one(spark, X.tokenize_vectorizer, "a bb ccc") == ["bb", "ccc"]
    assert one(spark, X.tokenize_segments, "Hi, 42!") == ["Hi", ",", "42", "!"]


def test_ngrams(spark):
    assert one(spark, lambda c: X.ngrams(X.tokenize_words(c), 1, 2), "a b c") == ["a", "b", "c", "a b", "b c"]
    assert one(spark, lambda c: X.ngrams(X.tokenize_words(c), 1, 2), "") == []
    assert one(spark, lambda c: X.ngrams(X.tokenize_words(c), 2, 2), "a") == []


def test_parse_topic_words(spark):
    r = one(spark, lambda c: X.parse_topic_words(c, 3, "clustering "), "clustering war, , peace ,x,y")
    assert r == ["war", "peace", "x"]
