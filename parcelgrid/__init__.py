"""parcelgrid: land-parcel screening as Spark DataFrame operators."""
