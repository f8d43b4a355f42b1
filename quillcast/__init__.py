"""quillcast: entity features, forecasting and corpus preparation as Spark DataFrame jobs."""
