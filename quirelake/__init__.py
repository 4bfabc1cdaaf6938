"""quirelake: document processing, retrieval and quality analytics as Spark plans."""
