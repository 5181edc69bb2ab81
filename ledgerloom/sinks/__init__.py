"""Sinks: artifacts, review queue, voucher XML, reports and uploads."""
