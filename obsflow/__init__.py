"""obsflow: traces, logs, alerts and service health as Spark DataFrame operators."""
