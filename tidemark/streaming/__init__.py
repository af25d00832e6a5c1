from .micro_batch import clean_stream, dedup_stream, issue_rates

__all__ = ["clean_stream", "dedup_stream", "issue_rates"]
