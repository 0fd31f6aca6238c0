"""Vireo: Spark-native perceptual quality analytics for images and video."""
