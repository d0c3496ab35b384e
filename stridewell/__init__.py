"""stridewell: endurance-training and wearable-health analytics as Spark DataFrame operators."""
