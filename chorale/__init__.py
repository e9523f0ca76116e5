"""A conversation-analytics engine on Spark: declared plans over ordered message logs."""
