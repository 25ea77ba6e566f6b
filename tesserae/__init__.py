"""tesserae: table analytics and training-data operators as Spark jobs."""
