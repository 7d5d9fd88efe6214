"""msgspark: message-corpus analytics and classification as Spark jobs."""

__version__ = "0.1.0"
