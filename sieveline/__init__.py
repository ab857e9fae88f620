"""Capacity-limited review queues as Spark plans: profiling, preparation, ranking, selection and evaluation."""
