"""Spark-native entity verification and risk scoring over whole tables of vendors."""
