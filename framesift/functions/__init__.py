"""Part of framesift."""
