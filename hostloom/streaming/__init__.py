"""Structured Streaming forms of the window and alert operators.

Event time is the time of the log entry. Late rows are dropped by the watermark; window
results come once, when their window closes (append mode).
"""
