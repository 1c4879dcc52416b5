"""Neural classifiers of feature vectors by ``pyspark.ml``."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def three_parts(key: Column, train: int = 60, validation: int = 20) -> Column:
    """train, validation or test by a hash of the key."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit("split:"), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % 100
    return F.when(h < train, "train").when(h < train + validation, "validation").otherwise("test")


def usable(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """Rows with a label and a vector without nulls and numbers that aren't finite, as label (a string) and features (a vector)."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & ~bad).withColumn("label_text", F.col(label).cast("string")).withColumn("features", array_to_vector(v))


def perceptron(train: DataFrame, hidden: list[int], inputs: int, labels: int, iterations: int = 100, seed: int = 7) -> PipelineModel:
    """A scaler and a perceptron with layers of ``hidden`` units, trained on rows of ``usable`` that have ``inputs`` components and ``labels`` different labels. The rows stay where they are; each
    iteration sums gradients over them."""
    index = StringIndexer(inputCol="label_text", outputCol="label_at", handleInvalid="keep", stringOrderType="alphabetAsc")
    scale = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    net = MultilayerPerceptronClassifier(featuresCol="scaled", labelCol="label_at", layers=[inputs, *hidden, labels], maxIter=iterations, seed=seed, blockSize=128)
    index = index.fit(train)
    back = IndexToString(inputCol="prediction", outputCol="best", labels=index.labels)
    return Pipeline(stages=[index, scale, net, back]).fit(train)


def best_network(rows: DataFrame, key: str, label: str, vector: str, sizes: list[list[int]], iterations: int = 100) -> tuple[DataFrame, list[float]]:
    """``rows`` of the test part with ``best`` (the label's text) and ``scores`` (by label in alphabetical order) by the network, of those with layers of ``sizes``, that is right most often on the
    validation part, and how often each one is. Of equally good ones the first counts."""
    part = usable(rows, label, vector).withColumn("part", three_parts(F.col(key)))
    train = part.where("part = 'train'")
    shape = train.agg(F.max(F.size(vector)).alias("inputs"), F.countDistinct("label_text").alias("labels")).first()
    nets = [perceptron(train, s, shape["inputs"], shape["labels"], iterations) for s in sizes]
    right = lambda net: net.transform(part.where("part = 'validation'")).agg(F.avg((F.col("best") == F.col("label_text")).cast("double"))).first()[0] or 0.0
    found = [right(net) for net in nets]
    net = nets[max(range(len(nets)), key=lambda i: (found[i], -i))]
    out = net.transform(part.where("part = 'test'"))
    return out.select(*rows.columns, "best", vector_to_array("probability").alias("scores"), F.col("label_at").cast("int").alias("label_at")), found
