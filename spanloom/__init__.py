"""Spark-native analytics over source trees and large text corpora."""
